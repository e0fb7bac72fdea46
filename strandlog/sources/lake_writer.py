"""From appended records to lake tables, as each topic's schema and options say."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlog.operators import lake

from .schemas import Registry
from .table import LakeTable

DATABASE = "strandlog"


def write(records: DataFrame, options: DataFrame, generated: DataFrame, registry: Registry, root: str, database: str = DATABASE, key: str | None = None) -> dict[str, str]:
    """records (topic, partition, ts, k, v, attributes) -> the path of each topic's table.

    options and generated are as produce.options() and produce.generated() give them. Every topic with a schema has a table, which is created where it is
    absent and gets columns that it lacks; topics without schema and control records are passed. The driver goes through the topics of the registry.
    key: the name of this write. With it tables have a log of commits (LakeTable), and a write of a name that a table has is passed.
    """
    own = {r.topic: r for r in options.collect()}  # a row a topic
    more: dict[str, dict[str, str]] = {}
    for r in generated.collect():  # a row a generated column
        more.setdefault(r.topic, {})[r.column] = r.expression
    rows = lake.for_lake(records, list(registry))
    out = {}
    for topic in registry:
        o = own.get(topic)
        typed = registry[topic].rows(rows.where(F.col("topic") == topic))
        said = {} if o is None else {"normalize": o.lake_normalize == "true", "separator": o.lake_normalize_separator, "partition": o.lake_partition, "z_order": o.lake_z_order}
        if key is None:
            out[topic] = lake.store(typed, root, database, topic, generated=more.get(topic, {}), **said)
        else:
            out[topic] = f"{root}/{database}.{topic}"
            LakeTable(records.sparkSession, out[topic]).append(*lake.prepared(typed, generated=more.get(topic, {}), **said), key=key)
    return out
