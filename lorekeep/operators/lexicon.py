"""A stored index for the lexical leg: a trigram dictionary of words, and postings in blocks of records that are near in time.

Records of a scope, newest first, stand in blocks of ``BLOCK`` rows. For each word and block there is a list of the block's
rows that hold it. A question's terms find their words by the dictionary (a word that holds a term has the term's first
three letters), the words find their lists, and before any list is opened each block has a bound: the sum of the question's terms that
have a list there. Blocks are opened best bound first, newest first, until they are sure to hold as many records as are wanted; the last of
these is the mark, and of the other blocks only those are opened whose bound, or at the same bound whose newest record, is not below it.
So a common term does not bring every record into a ranking, and the result is that of ``recall.lexical_leg`` row by row.

Stored below a path (``sources.parts``): ``grams`` (gram, token), ``postings`` and ``blocks`` of each part. ``build`` writes a version, ``append``
a part more of it. Records are indexed as they are given; one that has changed is indexed anew by the next version.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import Config
from ..functions import text
from ..sources import parts
from ..sources.shared import written
from .scope import as_of
from .sizes import small

#: Rows of a block.
BLOCK = 1024

_SCOPE = ("user_id", "agent_type", "project_id", "customer_id", "is_active")
_WHERE = ("block", "cell")


@dataclass(frozen=True)
class Index:
    path: str
    version: int
    grams: DataFrame
    postings: DataFrame
    blocks: DataFrame


def _grams(word: Column) -> Column:
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(word) - 2), lambda i: F.substring(word, i, F.lit(3))))


def _write_part(records: DataFrame, path: str, version: int, part: int, block: int) -> None:
    spark = records.sparkSession
    hay = text.haystack(F.col("content"), F.col("context_summary"))
    rows = records.select("id", *_SCOPE, "created_at", "occurred_at", F.array_distinct(text.tokens(hay)).alias("tokens"))
    # ranges of scope and time: a crowded scope is many tasks' work, and rows of a block are near in time
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartitionByRange(tasks, *(F.col(c) for c in _SCOPE), F.desc("created_at"), "id").sortWithinPartitions(*_SCOPE, F.desc("created_at"), "id")
    number = F.monotonically_increasing_id()
    placed = ordered.withColumn("number", number).withColumns({"block": F.floor(F.col("number") / block), "place": (F.col("number") % block).cast("int"), "cell": F.xxhash64(*_SCOPE, *(F.col(c).isNull() for c in _SCOPE))})
    stored = written(placed.drop("number"), "placed")  # numbers are given once

    row = F.struct("place", "id", "created_at", "occurred_at")
    of_block = stored.groupBy(*_WHERE, *_SCOPE).agg(F.collect_list(row).alias("rows"))  # ``block`` rows at most
    of_block.write.mode("overwrite").parquet(parts.place(path, "blocks", version, part))
    words = stored.select(*_WHERE, "place", "created_at", "occurred_at", F.explode("tokens").alias("token")).where(F.length("token") >= 3)
    # lists are sent once and without their scopes, which are those of their blocks
    lists = words.groupBy("token", *_WHERE).agg(F.collect_list("place").alias("places"), F.max("created_at").alias("newest"), F.min("occurred_at").alias("earliest"))
    scopes = spark.read.parquet(parts.place(path, "blocks", version, part)).select(*_WHERE, *_SCOPE)
    kept = parts.place(path, "postings", version, part)
    lists.join(small(scopes, Config().max_broadcast_bytes), list(_WHERE)).sortWithinPartitions("token").write.mode("overwrite").parquet(kept)
    known = spark.read.parquet(kept).select("token").distinct()
    known.select("token", F.explode(_grams(F.col("token"))).alias("gram")).hint("rebalance", "gram").sortWithinPartitions("gram").write.mode("overwrite").parquet(parts.place(path, "grams", version, part))
    parts.finish(spark, path, version, part, stored.count())


def build(records: DataFrame, path: str, block: int = BLOCK) -> Index:
    """A new version with all records."""
    version = max((x[0] for x in parts.finished(records.sparkSession, path)), default=0) + 1
    _write_part(records, path, version, 0, block)
    return load(records.sparkSession, path)


def append(index: Index, records: DataFrame, block: int = BLOCK) -> Index:
    """The version with more records; what is stored is not touched."""
    part = max(parts.newest(records.sparkSession, index.path)[1]) + 1
    _write_part(records, index.path, index.version, part, block)
    return load(records.sparkSession, index.path)


def load(spark: SparkSession, path: str) -> Index:
    version, some = parts.newest(spark, path)
    # blocks of different parts may have the same number: the part is one of a block's names
    tables = [spark.read.option("basePath", f"{path}/{name}/version={version}").parquet(*(parts.place(path, name, version, p) for p in some)) for name in ("grams", "postings", "blocks")]
    return Index(path, version, *tables)


def words_of(index: Index, terms: DataFrame, most_bytes: int) -> DataFrame:
    """(token, term): the words of the dictionary that hold a term."""
    heads = small(terms.select("term", F.substring("term", 1, 3).alias("gram")), most_bytes)
    return index.grams.join(heads, "gram").where(F.contains("token", "term")).select("token", "term").distinct()


_BLOCK = ("part", *_WHERE)


def _hits(index: Index, lists: DataFrame, opened: DataFrame) -> DataFrame:
    """(qid, part, block, cell, id, created_at, overlap): the rows of the opened blocks and how many of the terms they hold."""
    each = lists.join(opened.select("qid", *_BLOCK), ["qid", *_BLOCK]).select("qid", "as_of", *_BLOCK, "term", "times", F.explode("places").alias("place")).distinct()
    found = each.groupBy("qid", "as_of", *_BLOCK, "place").agg(F.sum("times").alias("overlap"))
    rows = index.blocks.join(opened.select(*_BLOCK).distinct(), list(_BLOCK), "left_semi").select(*_BLOCK, F.inline("rows"))
    return found.join(rows, [*_BLOCK, "place"]).where(as_of()).select("qid", "id", "created_at", "overlap")


def _first(hits: DataFrame, limit: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("overlap"), F.desc("created_at"), "id"))
    return hits.withColumn("_n", place).where(F.col("_n") <= limit)


def plan(index: Index, questions: DataFrame, scope: Column, config: Config) -> tuple[DataFrame, DataFrame]:
    """(the lists of each question's terms, its blocks): a block has a bound of the overlap there, its newest row, and the sum ``before`` it of rows that are sure to be hits."""
    asked = questions.select("qid", "as_of", F.explode(text.query_terms(F.col("query"))).alias("term")).groupBy("qid", "as_of", "term").agg(F.count("*").alias("times"))
    asked = written(asked, "asked")
    words = written(words_of(index, asked.select("term").distinct(), config.max_broadcast_bytes), "words")
    met = index.postings.where(scope).join(small(words, config.max_broadcast_bytes), "token")
    old = F.col("as_of").isNull() | (F.col("earliest") <= F.col("as_of"))
    lists = met.join(small(asked, config.max_broadcast_bytes), "term").where(old).select("qid", "as_of", *_BLOCK, "term", "times", "newest", "places")
    of_term = lists.groupBy("qid", "as_of", *_BLOCK, "term").agg(F.max("times").alias("times"), F.max("newest").alias("newest"), F.max(F.size("places")).alias("n"))
    # with a bound in time no row of a list is surely a hit
    blocks = of_term.groupBy("qid", *_BLOCK).agg(F.sum("times").alias("bound"), F.max("newest").alias("newest"), F.max(F.when(F.col("as_of").isNull(), F.col("n")).otherwise(F.floor(F.col("n") / 2))).alias("sure"))
    if not config.lexical_any:
        need = questions.select("qid", F.size(text.query_terms(F.col("query"))).alias("need"))
        blocks = blocks.join(need, "qid").where("bound = need").drop("need")
    order = Window.partitionBy("qid").orderBy(F.desc("bound"), F.desc("newest"), *_BLOCK)
    return lists, blocks.withColumn("before", F.sum("sure").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("sure"))


def index_leg(index: Index, questions: DataFrame, scope: Column, config: Config) -> DataFrame:
    """(qid, id, rank, overlap) of the records in scope, as ``recall.lexical_leg`` gives them."""
    lists, blocks = plan(index, questions, scope, config)
    blocks = written(blocks, "blocks")
    need = questions.select("qid", F.size(text.query_terms(F.col("query"))).alias("need"))
    every = lambda hits: hits if config.lexical_any else hits.join(need, "qid").where("overlap = need").drop("need")
    head = written(_first(every(_hits(index, lists, blocks.where(F.col("before") < config.candidate_limit))), config.candidate_limit), "head")
    marks = head.where(F.col("_n") == config.candidate_limit).select("qid", F.col("overlap").alias("mark"), F.col("created_at").alias("at"))
    rest = blocks.where(F.col("before") >= config.candidate_limit).join(marks, "qid", "left").where("mark IS NULL OR bound > mark OR (bound = mark AND newest >= at)")
    hits = head.drop("_n").unionByName(every(_hits(index, lists, rest)))
    return _first(hits, config.candidate_limit).select("qid", "id", (F.col("_n") - 1).alias("rank"), "overlap")
