"""Names of all queries over the driver's tables, with the SQL that must give the same rows."""

from lociweave.plans import relational, repairing, reporting

QUERIES = relational.QUERIES | repairing.QUERIES | reporting.QUERIES
ORACLES = relational.ORACLES | repairing.ORACLES | reporting.ORACLES
