"""What the codes mean."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

CODES = {
    "E0001": "front-matter can't be read", "E0002": "reserved", "E0003": "a file can't be read", "E0010": "a path is absolute", "E0011": "a path leaves the root", "E0012": "a path goes through a symbolic link",
    "E0021": "a rule names a field its schema doesn't have", "E0022": "a rule compares values of different types", "E0030": "no route claims a file", "E0031": "a governing document is absent", "E0032": "several routes claim a file",
    "E0050": "front-matter breaks its schema", "E0060": "a deployed file was changed", "E0061": "pinned content changed", "E0062": "a pinned file can't be read", "E0063": "a pinned section is absent", "E0070": "the root can't be resolved", "E0080": "the run failed",
    "E0090": "a term isn't registered", "E0091": "a label fits no scheme", "E0092": "a reserved term is used", "E0093": "an anti-pattern is used", "E0094": "a numeric claim drifted", "E0100": "a cited file is absent", "E0101": "cited lines are absent",
    "E0110": "a link is dead", "E0111": "an anchor is dead", "E0112": "a marked name is unknown", "E0113": "a code isn't in its catalog", "E0120": "a section has a wrong count", "E0121": "two sections share an id", "L0001": "a pin was lifted",
    "W0040": "front-matter is missing", "W0041": "a name breaks its grammar", "W0042": "a pin was lifted without a reason", "W0043": "the vocabulary is in scope of no file", "W0044": "a term has conflicting states", "W0045": "a class has neither schema nor rule",
    "W0046": "a glob matches nothing", "W0047": "there is no schema folder", "W0048": "a target is over the size limit", "W0049": "an index source was left out", "W0050": "a rule names a value outside the enum",
}


def explain(code: str) -> str | None:
    return CODES.get(code.rsplit("-", 1)[-1])


def table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(sorted(CODES.items()), "code string, title string")
