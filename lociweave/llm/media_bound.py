"""Which images of two blocks may be copies: the part of op6 that runs for every pair, in Java.

For each pair of images all descriptors are compared, and each match's similarity is tried on all matches near it in
angle and scale, as in ``media_copies.consensus``, with slightly wider tolerances. A pair of images that this leaves
out has no consensus. Numpy needs some 0.5 ms a pair for this.

The source is compiled by the compiler that Spark brings for its own generated code, so nothing but Spark is needed;
the class reaches the executors as a jar.
"""

from __future__ import annotations

import hashlib
import io
import zipfile

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from lociweave.runtime import scratch_path

_SOURCE = """
package lociweave;

import java.nio.ByteBuffer;
import java.nio.ByteOrder;

public class NAME implements org.apache.spark.sql.api.java.UDF8, java.io.Serializable {
    static final double TURN = TURN_VALUE, STRETCH = STRETCH_VALUE, TOLERANCE = TOLERANCE_VALUE, LEAST = LEAST_VALUE, CHANCE = CHANCE_VALUE;
    static final int BITS = BITS_VALUE, EDGE = EDGE_VALUE;
    static final int SECTORS = 128, APART = (int) (TURN / (2 * Math.PI) * SECTORS) + 2;  // one more for rounding

    static class Block {
        int n; int[] end; double[] x, y, scale, angle, cos, sin, area; long[] one, two;

        Block(Object counts, Object places, Object words) {
            ByteBuffer c = ByteBuffer.wrap((byte[]) counts).order(ByteOrder.LITTLE_ENDIAN), p = ByteBuffer.wrap((byte[]) places).order(ByteOrder.LITTLE_ENDIAN), w = ByteBuffer.wrap((byte[]) words).order(ByteOrder.LITTLE_ENDIAN);
            n = c.remaining() / 8;
            end = new int[n + 1];
            for (int i = 0; i < n; i++) end[i + 1] = end[i] + (int) c.getLong();
            int m = end[n];
            x = new double[m]; y = new double[m]; scale = new double[m]; angle = new double[m]; cos = new double[m]; sin = new double[m]; one = new long[m]; two = new long[m];
            for (int j = 0; j < m; j++) {
                x[j] = p.getFloat(); y[j] = p.getFloat(); scale[j] = p.getFloat(); angle[j] = p.getFloat();
                cos[j] = Math.cos(angle[j]); sin[j] = Math.sin(angle[j]);
                one[j] = w.getLong(); two[j] = w.getLong();
            }
            area = new double[n];
            for (int i = 0; i < n; i++) {
                double x0 = 1e300, x1 = -1e300, y0 = 1e300, y1 = -1e300;
                for (int j = end[i]; j < end[i + 1]; j++) {
                    x0 = Math.min(x0, x[j]); x1 = Math.max(x1, x[j]); y0 = Math.min(y0, y[j]); y1 = Math.max(y1, y[j]);
                }
                area[i] = (x1 - x0 + EDGE) * (y1 - y0 + EDGE);
            }
        }
    }

    static class Room {
        int size; int[] a, b, sector, first = new int[2 * SECTORS + 1], next = new int[SECTORS];
        float[] qx, qy, mx, my, off;
        double[] ratio, c, s;
        int[] sa, sb; long[] places;

        void hold(int n) {
            if (n <= size) return;
            size = n;
            a = new int[n]; b = new int[n]; sector = new int[n]; sa = new int[2 * n]; sb = new int[2 * n]; places = new long[n];
            qx = new float[2 * n]; qy = new float[2 * n]; mx = new float[2 * n]; my = new float[2 * n]; off = new float[2 * n]; ratio = new double[2 * n]; c = new double[2 * n]; s = new double[2 * n];
        }
    }

    /** All pairs of descriptors near enough, with room made as they come. */
    static int match(Block q, int k, Block m, int i, Room r) {
        int n = 0, from = m.end[i], to = m.end[i + 1];
        for (int a = q.end[k]; a < q.end[k + 1]; a++) {
            if (n + to - from > r.size) {
                int[] a0 = r.a, b0 = r.b;
                r.hold(2 * (n + to - from));
                if (n > 0) { System.arraycopy(a0, 0, r.a, 0, n); System.arraycopy(b0, 0, r.b, 0, n); }
            }
            n = row(q.one[a], q.two[a], a, m.one, m.two, from, to, r.a, r.b, n);
        }
        return n;
    }

    static int row(long one, long two, int a, long[] ones, long[] twos, int from, int to, int[] as, int[] bs, int n) {
        for (int b = from; b < to; b++) {
            if (Long.bitCount(one ^ ones[b]) + Long.bitCount(two ^ twos[b]) <= BITS) {
                as[n] = a;
                bs[n++] = b;
            }
        }
        return n;
    }

    /** How many matches land within reach, a square; their distances stay in off. Two loops without branches are faster than one that leaves early. */
    static int landing(float c, float s, float dx, float dy, float reach, float[] qx, float[] qy, float[] mx, float[] my, float[] off, int from, int to) {
        for (int j = from; j < to; j++) {
            float ex = c * qx[j] - s * qy[j] + dx - mx[j], ey = s * qx[j] + c * qy[j] + dy - my[j];
            off[j] = ex * ex + ey * ey;
        }
        int n = 0;
        for (int j = from; j < to; j++) if (off[j] <= reach) n++;
        return n;
    }

    static int distinct(long[] of, int n) {
        java.util.Arrays.sort(of, 0, n);
        int k = n > 0 ? 1 : 0;
        for (int j = 1; j < n; j++) if (of[j] != of[j - 1]) k++;
        return k;
    }

    static long place(double x, double y) {
        return ((long) Math.rint(x / 2) << 32) ^ ((long) Math.rint(y / 2) & 0xffffffffL);
    }

    static boolean likely(Block q, int k, Block m, int i, Room r) {
        int n = match(q, k, m, i, r);
        if (n < LEAST) return false;
        int[] first = r.first, next = r.next;
        java.util.Arrays.fill(first, 0);
        for (int j = 0; j < n; j++) {
            double turn = (m.angle[r.b[j]] - q.angle[r.a[j]]) / (2 * Math.PI);
            r.sector[j] = Math.min(SECTORS - 1, (int) ((turn - Math.floor(turn)) * SECTORS));
            first[r.sector[j] + 1]++;
        }
        for (int t = 0; t < SECTORS; t++) { first[t + 1] += first[t]; next[t] = first[t]; }
        for (int t = 0; t < SECTORS; t++) first[SECTORS + t + 1] = n + first[t + 1];
        double far = 0, wide = 0;
        for (int j = 0; j < n; j++) {
            int a = r.a[j], b = r.b[j], at = next[r.sector[j]]++;
            double ratio = m.scale[b] / q.scale[a];
            r.qx[at] = (float) q.x[a]; r.qy[at] = (float) q.y[a]; r.mx[at] = (float) m.x[b]; r.my[at] = (float) m.y[b]; r.ratio[at] = ratio; r.sa[at] = a; r.sb[at] = b;
            r.c[at] = ratio * (m.cos[b] * q.cos[a] + m.sin[b] * q.sin[a]);
            r.s[at] = ratio * (m.sin[b] * q.cos[a] - m.cos[b] * q.sin[a]);
            far = Math.max(far, q.x[a] + q.y[a]);
            wide = Math.max(wide, m.x[b] + m.y[b]);
        }
        System.arraycopy(r.qx, 0, r.qx, n, n); System.arraycopy(r.qy, 0, r.qy, n, n); System.arraycopy(r.mx, 0, r.mx, n, n); System.arraycopy(r.my, 0, r.my, n, n);
        System.arraycopy(r.ratio, 0, r.ratio, n, n); System.arraycopy(r.c, 0, r.c, n, n); System.arraycopy(r.s, 0, r.s, n, n); System.arraycopy(r.sa, 0, r.sa, n, n); System.arraycopy(r.sb, 0, r.sb, n, n);
        double apart = Math.log(STRETCH) + 1e-9, least = Math.cos(TURN) - 1e-9;
        for (int t = 0; t < SECTORS; t++) {
            int back = (t + SECTORS - APART) % SECTORS, from = first[back], to = first[back + 2 * APART + 1];
            for (int p = first[t]; p < first[t + 1]; p++) {
                double ratio = r.ratio[p], c = r.c[p], s = r.s[p], reach = TOLERANCE * Math.max(1.0, ratio);
                double need = LEAST + CHANCE * n * Math.PI * reach * reach / Math.max(m.area[i], q.area[k] * ratio * ratio) - 1e-6;
                if (to - from < need) continue;
                double dx = r.mx[p] - (c * r.qx[p] - s * r.qy[p]), dy = r.my[p] - (s * r.qx[p] + c * r.qy[p]);
                reach += 4e-6 * (ratio * far + Math.abs(dx) + Math.abs(dy) + wide);  // consensus and landing compute in 32 bits
                reach *= reach;
                if (landing((float) c, (float) s, (float) dx, (float) dy, (float) reach, r.qx, r.qy, r.mx, r.my, r.off, from, to) < need) continue;
                for (int side = 0; side < 2; side++) {
                    int found = 0;
                    for (int j = from; j < to; j++) {
                        if (r.off[j] <= (float) reach && (c * r.c[j] + s * r.s[j]) >= least * ratio * r.ratio[j] && Math.abs(Math.log(r.ratio[j] / ratio)) <= apart)
                            r.places[found++] = side == 0 ? place(r.qx[j], r.qy[j]) : place(r.mx[j], r.my[j]);
                    }
                    if (distinct(r.places, found) < need) break;
                    if (side == 1) return true;
                }
            }
        }
        return false;
    }

    public Object call(Object a, Object b, Object c, Object d, Object e, Object f, Object g, Object h) {
        Block q = new Block(b, c, d), m = new Block(f, g, h);
        Room room = new Room();
        room.hold(1024);
        ByteBuffer found = ByteBuffer.allocate(1024).order(ByteOrder.LITTLE_ENDIAN);
        for (int k = 0; k < q.n; k++)
            for (int i = 0; i < m.n; i++)
                if (likely(q, k, m, i, room)) {
                    if (found.remaining() < 8) {
                        ByteBuffer more = ByteBuffer.allocate(2 * found.capacity()).order(ByteOrder.LITTLE_ENDIAN);
                        more.put(found.array(), 0, found.position());
                        found = more;
                    }
                    found.putInt(k);
                    found.putInt(i);
                }
        return java.util.Arrays.copyOf(found.array(), found.position());
    }
}
"""


def likely_pairs(spark: SparkSession, values: dict[str, float], asked: list[str], media: list[str]) -> Column:
    """Pairs of 32-bit places, (query of its block, image of its block), little-endian; ``values`` are the constants."""
    source = _SOURCE
    for name, value in values.items():
        source = source.replace(f"{name}_VALUE", repr(value))
    name = "Likely" + hashlib.sha256(source.encode()).hexdigest()[:16]
    if not spark.catalog.functionExists(name):
        _register(spark, name, source.replace("NAME", name))
    return F.call_function(name, *map(F.col, [*asked, *media]))


def _register(spark: SparkSession, name: str, source: str) -> None:
    jvm = spark.sparkContext._jvm
    compiler = jvm.org.codehaus.janino.SimpleCompiler()
    compiler.setParentClassLoader(jvm.java.lang.Thread.currentThread().getContextClassLoader())
    compiler.cook(source)
    jar = io.BytesIO()
    with zipfile.ZipFile(jar, "w") as z:
        for full, code in compiler.getBytecodes().items():
            z.writestr(full.replace(".", "/") + ".class", bytes(code))
    path = jvm.org.apache.hadoop.fs.Path(scratch_path(spark, name) + ".jar")
    out = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(path)
    out.write(bytearray(jar.getvalue()))
    out.close()
    spark.sparkContext._jsc.addJar(path.toString())
    made = compiler.getClassLoader().loadClass(f"lociweave.{name}").getDeclaredConstructor(spark.sparkContext._gateway.new_array(jvm.java.lang.Class, 0)).newInstance(spark.sparkContext._gateway.new_array(jvm.java.lang.Object, 0))
    spark._jsparkSession.udf().register(name, made, jvm.org.apache.spark.sql.types.DataTypes.BinaryType)
