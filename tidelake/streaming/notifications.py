"""Change notifications of catalogs, in the three shapes in which they come, as Column expressions over JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Event types that mean that a table changed, the mark of a cloud event, and what parts a namespace.
CHANGED, MARK, PART = ("updateTable", "createTable", "registerTable"), "specversion", "\x1f"


def notified(events: DataFrame) -> DataFrame:
    """events (body: JSON text, headers: map of lower-case names, query: text; all may be null) with `outcome` (table,
    ignored or refused), `catalog`, `namespace` (array) and `table`.

    A body with catalog, namespace (array of texts) and table names a table. A cloud event, by its body's `specversion`
    or by a ce-specversion header, is ignored unless its type is one of CHANGED and its tabular-type, if any, is table;
    else its namespace and name, and the catalog of the query, name the table. Whatever else is refused. Malformed JSON,
    empty texts and missing parts are refused, an empty table stays empty.
    """
    value = F.try_parse_json("body")
    part = lambda name: F.try_variant_get(value, f"$['{name}']", "variant")
    text = lambda v: F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string"))
    binary, structured = F.coalesce(F.map_contains_key("headers", f"ce-{MARK}"), F.lit(False)), part(MARK).isNotNull()

    def attribute(name: str) -> Column:
        return F.when(binary, F.try_element_at("headers", F.lit(f"ce-{name}"))).otherwise(text(part(name)))

    pairs = F.split(F.coalesce("query", F.lit("")), "&")
    asked = F.filter(F.transform(F.filter(pairs, lambda p: p.startswith("catalog=")), lambda p: F.substring(p, 9, 1 << 30)), lambda c: F.lit(True))
    asked = F.nullif(F.try_element_at(asked, F.lit(1)), F.lit(""))
    rows = events.withColumns({"_cloud": binary | structured, "_type": attribute("type"), "_kind": attribute("tabular-type"), "_space": attribute("namespace"), "_name": attribute("name"), "_asked": asked})
    own = {c: text(part(c)) for c in ("catalog", "table")}
    parts = F.try_variant_get(part("namespace"), "$", "array<variant>")
    parts = F.when(F.schema_of_variant(part("namespace")).startswith("ARRAY") & F.forall(parts, lambda p: F.coalesce(F.schema_of_variant(p) == "STRING", F.lit(False))), F.try_variant_get(part("namespace"), "$", "array<string>"))
    rows = rows.withColumns({"_catalog": own["catalog"], "_table": own["table"], "_parts": parts})
    cloud = F.col("_cloud")
    ignored = cloud & F.col("_type").isNotNull() & (~F.col("_type").isin(*CHANGED) | F.coalesce(F.col("_kind") != "table", F.lit(False)))
    named = F.when(cloud, F.col("_type").isNotNull() & F.col("_asked").isNotNull() & F.col("_space").isNotNull() & F.col("_name").isNotNull()).otherwise(F.col("_catalog").isNotNull() & F.col("_parts").isNotNull() & F.col("_table").isNotNull())
    outcome = F.when(ignored, "ignored").when(named, "table").otherwise("refused")
    rows = rows.withColumn("outcome", outcome)
    is_table = F.col("outcome") == "table"
    pick = lambda of_cloud, of_own: F.when(is_table & cloud, of_cloud).when(is_table, of_own)
    return rows.select(*events.columns, "outcome", pick(F.col("_asked"), F.col("_catalog")).alias("catalog"), pick(F.split("_space", PART), F.col("_parts")).alias("namespace"), pick(F.col("_name"), F.col("_table")).alias("table"))
