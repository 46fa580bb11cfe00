"""Inputs derived from the driver tables: a file corpus, a registry, queries, an index.

Every frame here covers all rows of the table it is derived from.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.functions.text import content_hash
from gleaner.operators.documents import union_documents
from gleaner.operators.embed import HashedTfIdf
from gleaner.plans.build import build_index, fit_model
from gleaner.session import scratch_path, ship_package, small_batches, spread

# One path form per source number; {} is the document id.
PATH_FORMS = (
    "pkg{}/__init__.py", "src/Solver{}.C", "src/solver{}.c", "src/x{}.hpp", "doc/a{}.rst",
    "_build/a{}.rst", "build/a{}.py", "tests/run{}.py", "tests/case{}/system/controls",
    "tests/case{}/constant/a.cfg", "tests/case{}/system/gen.py", "tests/case{}/0.orig/U",
    "tests/case{}/0/T", "tests/{}/system", "case{}/system/controls", "README{}", "a{}.tar.gz",
    "guide/{}.md", "conf/..{}a", "etc/site{}.yml",
)

# Model names with every prefix family, one in mixed case.
MODELS = (
    "mixedbread-ai/mxbai-embed-large-v1", "intfloat/e5-base-v2", "thenlper/gte-large",
    "Snowflake/Snowflake-Arctic-Embed-L", "BAAI/bge-m3", "MXBAI-e5",
)

# Collections asked for; the last is not a known name.
KNOWN = ("code", "docs", "tests", "tutorials", "archive")
ASKED = (*KNOWN, "nowhere")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def text_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table whose text is costly to process, spread over the cores."""
    return spread(table(spark, sf_dir, name))


def source_number(source: Column) -> Column:
    return F.regexp_extract(source, r"(\d+)", 1).cast("int")


def _pick(values: tuple[str, ...], at: Column) -> Column:
    return F.element_at(F.array(*[F.lit(value) for value in values]), (at + 1).cast("int"))


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as a file corpus with malformed, blank and unreadable files among them."""
    form = _pick(PATH_FORMS, F.pmod(source_number(F.col("source")), F.lit(len(PATH_FORMS))))
    content = (
        F.when((F.col("source") == "src9") & (F.col("lang") == "fr"), None)
        .when(F.col("n_chars") < 200, F.lit(" \n\t").cast("binary"))
        .when(F.col("lang") == "de", F.concat(F.col("text").cast("binary"), F.unhex(F.lit("FFFE"))))
        .otherwise(F.col("text").cast("binary"))
    )
    return text_table(spark, sf_dir, "documents").select(
        "source",
        F.lit("main").alias("branch"),
        F.replace(form, F.lit("{}"), F.col("doc_id").cast("string")).alias("file_path"),
        content.alias("content"),
    )


def branches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Branches of each source, by document language."""
    number, lang = source_number(F.col("source")), F.col("lang")
    name = (
        F.when(lang == "en", F.when(number % 3 == 0, "trunk").otherwise("main"))
        .when(lang == "fr", F.when(number % 2 == 0, "work").otherwise("master"))
        .otherwise(lang)
    )
    return table(spark, sf_dir, "documents").select(
        "source", name.alias("branch"), (lang == "de").alias("active")
    ).distinct()


def registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A registry entry per document source, with gaps where defaults apply."""
    number = source_number(F.col("source"))
    category = (
        F.when(number % 4 == 0, "tutorials").when(number % 4 == 1, "prerequisite")
        .when(number % 4 == 2, "docs")
    )
    return table(spark, sf_dir, "documents").select("source").distinct().select(
        F.concat(F.lit("team/"), "source").alias("name"),
        F.concat(F.lit("https://git.example.com/"), "source").alias("url"),
        F.when(number % 3 != 0, "master").alias("branch"),
        category.alias("category"),
        F.when(number % 5 != 0, number % 5).alias("priority"),
    )


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark text as a query, over all collections and result counts."""
    item = F.col("item_id")
    return table(spark, sf_dir, "benchmark").select(
        F.concat(F.lit("q"), item.cast("string")).alias("query_id"),
        _pick(ASKED, item % len(ASKED)).alias("collection"),
        F.col("text").alias("query"),
        F.when(item % 7 != 0, item - 3).cast("int").alias("n_results"),
    )


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, placed in three collections by language."""
    lang = F.col("lang")
    collection = F.when(lang == "en", "code").when(lang == "fr", "docs").otherwise("tests")
    doc_key = F.concat(F.lit("doc"), F.col("doc_id").cast("string"))
    return union_documents(text_table(spark, sf_dir, "documents").select(
        collection.alias("collection"),
        doc_key.alias("doc_key"),
        "text",
        content_hash(F.col("text")).alias("content_hash"),
        F.when(lang == "en", F.concat("source", F.lit("/"), doc_key, F.lit(".py"))).alias("file_path"),
        F.when(lang == "fr", F.concat_ws("/", F.lit("https://docs.example.com"), doc_key)).alias("url"),
        "source",
        F.col("lang").alias("language"),
        F.when(lang == "de", "python_test").alias("doc_type"),
    ))


_FITTED: dict[tuple[str, str], tuple[str, HashedTfIdf]] = {}
_BUILT: set[str] = set()


def fitted(spark: SparkSession, sf_dir: str) -> tuple[str, HashedTfIdf]:
    """The model of all documents and the root it is stored below, fitted once per application: for queries that build an index of their own."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _FITTED:
        root = scratch_path(spark, "index")
        _FITTED[key] = root, fit_model(documents(spark, sf_dir), root)
    return _FITTED[key]


def index(spark: SparkSession, sf_dir: str) -> tuple[str, HashedTfIdf]:
    """Root and model of an index over all documents, built once per application.

    ``tutorials`` is built from no documents; ``archive`` is never built.
    """
    root, model = fitted(spark, sf_dir)
    if root not in _BUILT:
        build_index(documents(spark, sf_dir), root, ("code", "docs", "tests", "tutorials"), model, model.name)
        _BUILT.add(root)
    return root, model


def known_names(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(name,) for name in KNOWN], "collection string")
