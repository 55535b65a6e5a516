"""References to records that do not exist, at the time they were made, and what hangs on such records.

Whether a name exists at a time is decided by running sums, not by joining each reference with every life span of its name: births and
deaths of names and the distinct (name, time) of the references are put in order within (name, day), and each day starts from what was
alive before it. So a name that holds a large part of the references or of the life spans is spread over its days, and what is equal is
one row before any shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewright.functions import text as tx
from pagewright.session import cut, drop


def month_key(at: Column) -> Column:
    """yyyy-MM, or unknown for null."""
    return F.coalesce(F.date_format(at, "yyyy-MM"), F.lit("unknown"))


def alive(probes: DataFrame, spans: DataFrame) -> DataFrame:
    """The rows (name, at) of ``probes`` for which ``spans`` (name, born, died) has a span with born <= at < died; once each.

    A null died is never; a null born is never before any time. A null ``at`` is alive if any span has the name. Spans may overlap or repeat.
    """
    spans = spans.where(F.col("name").isNotNull())
    timed = probes.where("at is not null").select("name", "at").distinct()
    real = spans.where("born is not null and (died is null or died > born)")
    events = real.select("name", F.col("born").alias("at"), F.lit(1).alias("step")).unionByName(real.where("died is not null").select("name", F.col("died").alias("at"), F.lit(-1).alias("step")))
    events = events.groupBy("name", "at").agg(F.sum("step").alias("step"))
    day = F.to_date("at").alias("day")
    both = events.select("name", "at", "step", F.lit(False).alias("asked"), day).unionByName(timed.select("name", "at", F.lit(0).cast("bigint").alias("step"), F.lit(True).alias("asked"), day))
    by_day = events.groupBy("name", day).agg(F.sum("step").alias("net"))
    days = both.groupBy("name", "day").agg(F.max("asked").alias("asked")).join(by_day, ["name", "day"], "left")
    carried = F.coalesce(F.sum(F.coalesce("net", F.lit(0))).over(Window.partitionBy("name").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    start = days.select("name", "day", "asked", carried.alias("start")).where("asked").drop("asked")
    within = F.sum("step").over(Window.partitionBy("name", "day").orderBy("at").rangeBetween(Window.unboundedPreceding, Window.currentRow))
    running = both.withColumn("within", within).where("asked").select("name", "day", "at", "within")
    sound = running.join(start, ["name", "day"]).where(F.col("within") + F.col("start") > 0).select("name", "at")
    untimed = probes.where("at is null").select("name").distinct().join(spans.select("name").distinct(), "name", "left_semi")
    return sound.unionByName(untimed.select("name", F.lit(None).cast(sound.schema["at"].dataType).alias("at")))


def orphan_references(refs: DataFrame, spans: DataFrame) -> DataFrame:
    """The references none of whose names is alive at their time.

    ``refs``: src_table, src_field, row_id, ref_name, at, names (the names of which one must be alive; null ones are ignored).
    Result: src_table, src_field, row_id, ref_name, at; one row per row, field and name however often it is repeated. A reference without
    any name is none.

    Names are tried one after another: an anti-join on the first leaves few rows for the next.
    """
    key = ["src_table", "src_field", "row_id", "ref_name", "at"]
    given = F.filter("names", lambda n: n.isNotNull())
    rest = cut(refs.select(*key, given.alias("names")).where(F.size("names") > 0))
    most = rest.agg(F.max(F.size("names"))).first()[0] or 0
    found = cut(alive(rest.select("at", F.explode("names").alias("name")), spans)).select(F.col("name").alias("__name"), F.col("at").alias("__at"))
    for i in range(most):
        name = F.get("names", F.lit(i))
        rest = rest.join(found, (name == F.col("__name")) & F.col("at").eqNullSafe(F.col("__at")), "left_anti")
    return rest.select(*key).distinct()


def cascade(direct: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, depth): ``direct`` nodes with depth 0 and all nodes that refer to them over ``edges`` (child, parent), with the fewest steps.

    Fixpoint: each round takes the children of the last round's nodes (a semi-join down the graph) less those known already. Cycles end
    since a node is taken once. Lineage is cut each round.
    """
    edges = cut(edges.select("child", "parent").distinct())
    known = cut(direct.select("node").distinct().withColumn("depth", F.lit(0)))
    front, depth = known, 0
    while True:
        depth += 1
        near = edges.join(front.select(F.col("node").alias("parent")), "parent", "left_semi").select(F.col("child").alias("node")).distinct()
        front = cut(near.join(known, "node", "left_anti").withColumn("depth", F.lit(depth)))
        if front.isEmpty():
            drop(edges, front)
            return known
        grown = cut(known.unionByName(front))
        drop(known)
        known = grown


def text_references(queries: DataFrame, pages: DataFrame) -> DataFrame:
    """References to texts of query_list and image_page_metadata as ``orphan_references`` takes them.

    Null and blank values are none. A page's name stands for its stem or that without its page number.
    """

    def of(df: DataFrame, table: str, field: str, row_id: str, value: Column, at: str, paged: bool = False) -> DataFrame:
        r = df.select(F.lit(table).alias("src_table"), F.lit(field).alias("src_field"), F.col(row_id).alias("row_id"), value.alias("v"), F.col(at).alias("at")).where(~tx.is_blank(F.col("v")))
        r = r.withColumn("ref_name", tx.name_stem(F.col("v")))
        names = F.array_distinct(F.array("ref_name", F.regexp_replace("ref_name", r"_[0-9]+$", ""))) if paged else F.array("ref_name")
        return r.select("src_table", "src_field", "row_id", "ref_name", "at", names.alias("names"))

    targets = of(queries, "query_list", "pos_target_for_deepseek", "query_id", F.explode("pos_target_for_deepseek"), "created_at")
    page = of(pages, "image_page_metadata", "page_name", "page_id", F.col("page_name"), "rendered_at", paged=True)
    document = of(pages, "image_page_metadata", "document_name", "page_id", F.col("document_name"), "rendered_at")
    return targets.unionByName(page).unionByName(document)


def text_spans(files: DataFrame) -> DataFrame:
    """Life spans of texts: a text may be registered again after deletion, and more than once at a time."""
    return files.select(tx.name_stem(F.col("text_name")).alias("name"), F.col("registered_at").alias("born"), F.col("deleted_at").alias("died"))


def node(table: str | Column, key: Column) -> Column:
    """A row, or a document by its stem, as one string."""
    return F.concat_ws(":", F.lit(table) if isinstance(table, str) else table, key.cast("string"))


def record_edges(queries: DataFrame, pages: DataFrame, texts: DataFrame) -> DataFrame:
    """(child, parent) of the foreign-key graph of rows and of the names by which rows speak of each other.

    A document (by stem) hangs on its own row, the page row that names itself. Pages and queries hang on the documents they name. The words
    of a query (``norm``) hang on the queries that have them, and a clustered text on the queries it lists. So what hangs on a document's
    own row is up to four steps away. A name is one node however many rows speak of it, and hangs on each of them.
    """
    p = pages.select(node("image_page_metadata", F.col("page_id")).alias("row"), tx.name_stem(F.col("page_name")).alias("page"), tx.name_stem(F.col("document_name")).alias("doc")).where("doc <> ''")
    own = p.where("page = doc").select(node("document", F.col("doc")).alias("child"), F.col("row").alias("parent"))
    on_document = p.where("page is null or page <> doc").select(F.col("row").alias("child"), node("document", F.col("doc")).alias("parent"))
    query = node("query_list", F.col("query_id"))
    targets = queries.select(query.alias("child"), F.explode(tx.stem_set(F.col("pos_target_for_deepseek"))).alias("doc")).select("child", node("document", F.col("doc")).alias("parent"))
    words = queries.select(tx.norm(F.col("query")).alias("words"), query.alias("parent")).where("words <> ''").select(node("query", F.col("words")).alias("child"), "parent")
    listed = texts.select(node("data_text_with_cluster_ids", F.col("record_id")).alias("child"), F.explode(tx.term_set(F.col("querys"))).alias("words")).select("child", node("query", F.col("words")).alias("parent"))
    return own.unionByName(on_document).unionByName(targets).unionByName(words).unionByName(listed)


def orphan_nodes(found: DataFrame) -> DataFrame:
    """(node): rows with a reference among ``found``."""
    return found.select(node(F.col("src_table"), F.col("row_id")).alias("node")).distinct()
