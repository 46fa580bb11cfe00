"""The registered queries: (spark, sf_dir) to DataFrame, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.functions.queries import format_query, hit_label, result_count, score
from gleaner.functions.text import content_hash, decode_utf8, is_blank, language_tag, strip, suffix
from gleaner.functions.urls import canonical, site_base
from gleaner.operators.cells import (
    Cells, approximate_top_k, assign_cells, enough_probes, pruned_top_k, recall, write_cells,
)
from gleaner.operators.chunk import chunk_documents
from gleaner.operators.codes import coded_top_k, encode, fit_codebooks
from gleaner.operators.crawl import reachable
from gleaner.operators.documents import (
    PROFILES, documents_from_files, documents_from_pages, file_outcomes, ingest_stats,
    preferred_branch, registry_defaults, union_documents, with_registry,
)
from gleaner.operators.embed import HashedTfIdf, embed_text, fit_hashed_tfidf
from gleaner.operators.filters import select_sources
from gleaner.operators.knn import nearest, top_k
from gleaner.operators.mllib import fit_cells, mllib_embed, mllib_tfidf
from gleaner.operators.pages import distinct_targets, page_links, parse_pages
from gleaner.operators.recrawl import Crawled, links_of, recrawl
from gleaner.plans import derived
from gleaner.plans.build import build_index, chunks_of
from gleaner.plans.jobs import crawled_documents
from gleaner.plans.layout import cell_search, lay_out
from gleaner.plans.reembed import reembed
from gleaner.plans.refresh import changes, refresh
from gleaner.plans.search import search, search_text
from gleaner.plans.status import collection_counts, coverage, health, query_status
from gleaner.session import scratch_path, ship_package, stored
from gleaner.sources import index as store
from gleaner.sources.files import list_files, read_pieces, scan_files
from gleaner.sources.pages import scan_pages
from gleaner.sources.registry import scan_registry
from gleaner.streaming.refresh import stream_refresh

Query = Callable[[SparkSession, str], DataFrame]
REGISTERED: dict[str, Query] = {}

K = 5
# Fixed value: a unit vector in the space of the embeddings table.
PROBE = [0.125] * 64


def register(query: Query) -> Query:
    REGISTERED[query.__name__] = query
    return query


def _millionths(value: Column) -> Column:
    return F.round(value, 6)


# Nearest neighbours over the embeddings table: every vector is a query.


def _vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    vectors = derived.table(spark, sf_dir, "embeddings")
    asked = vectors.select(
        F.col("vec_id").alias("query_id"), "embedding", F.lit(K).alias("k"), "label"
    )
    return vectors, asked


def _scored(hits: DataFrame) -> DataFrame:
    return hits.select(
        "query_id", "vec_id", "rank", _millionths(F.col("distance")).alias("distance"),
        score(F.col("distance")).alias("score"),
    )


@register
def knn_single(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = derived.table(spark, sf_dir, "embeddings")
    hits = nearest(vectors, PROBE, 20, "vec_id")
    return hits.select(
        "vec_id", "label", _millionths(F.col("distance")).alias("distance"),
        score(F.col("distance")).alias("score"),
    )


@register
def knn_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors, asked = _vectors(spark, sf_dir)
    return _scored(top_k(vectors, asked, "vec_id"))


@register
def knn_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors, asked = _vectors(spark, sf_dir)
    return _scored(top_k(vectors, asked, "vec_id", metric="cosine"))


@register
def knn_by_collection(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors, asked = _vectors(spark, sf_dir)
    return _scored(top_k(vectors, asked, "vec_id", by="label"))


@register
def knn_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The plan for query sets too large to travel, forced."""
    vectors, asked = _vectors(spark, sf_dir)
    return _scored(top_k(vectors, asked, "vec_id", by="label", max_broadcast=0))


@register
def knn_routed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The plan for many queries over vectors laid out by cells, forced: each is routed to the cells that can hold a hit."""
    vectors, asked = _vectors(spark, sf_dir)
    root, name, key = scratch_path(spark, "vectors"), F.lit("vectors"), F.col("vec_id").cast("string")
    chunks = vectors.select(
        name.alias("collection"), key.alias("doc_key"), F.lit(0).alias("chunk_no"), F.lpad(key, 20, "0").alias("chunk_id"), "embedding")
    store.write_index(chunks, root, ["vectors"], "given", "rebuild")
    laid_out = lay_out(spark, root, "vectors", rows_per_cell=64)
    hits = cell_search(spark, root, [laid_out], asked.select("query_id", name.alias("collection"), "k", "embedding"), max_broadcast=0)
    return _scored(hits.withColumn("vec_id", F.split("place", r"\|")[0].cast("long")))


def _cells(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, Cells]:
    vectors, asked = _vectors(spark, sf_dir)
    cells = fit_cells(vectors, 32)
    placed = write_cells(assign_cells(vectors, cells), scratch_path(spark, "cells"))
    return placed, asked, cells


@register
def knn_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact search that skips the cells out of reach."""
    placed, asked, cells = _cells(spark, sf_dir)
    return _scored(pruned_top_k(placed, asked, cells, id_col="vec_id"))


# Share of the exact hits that the approximate searches are asked to find.
RECALL = 0.95


@register
def knn_approx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search of the nearest cells only, as many as a sample of the queries asks for."""
    placed, asked, cells = _cells(spark, sf_dir)
    nprobe = enough_probes(placed, asked, cells, RECALL, "vec_id")
    return _scored(approximate_top_k(placed, asked, cells, nprobe, id_col="vec_id"))


@register
def knn_coded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search of codes, the best of which are ranked by their vectors."""
    vectors, asked = _vectors(spark, sf_dir)
    books = fit_codebooks(vectors, id_col="vec_id")
    coded = stored(encode(vectors.select("vec_id", "embedding"), books), "codes")
    return _scored(coded_top_k(coded, vectors, asked, books, id_col="vec_id"))


def _recall(spark: SparkSession, sf_dir: str, found: Query) -> DataFrame:
    """Whether an approximate search finds nine of ten exact hits."""
    vectors, asked = _vectors(spark, sf_dir)
    exact = top_k(vectors, asked, "vec_id")
    share = recall(found(spark, sf_dir), stored(exact, "exact"), "vec_id")
    return asked.agg(F.count(F.lit(1)).alias("n_queries")).withColumn("enough", F.lit(share >= 0.9))


@register
def knn_approx_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _recall(spark, sf_dir, knn_approx)


@register
def knn_coded_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _recall(spark, sf_dir, knn_coded)


# Chunks, text statistics and metadata.


@register
def chunk_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = derived.text_table(spark, sf_dir, "documents").select("doc_id", "text")
    return chunk_documents(documents)


@register
def chunk_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = derived.text_table(spark, sf_dir, "documents").select("doc_id", "text")
    return chunk_documents(documents, "sentence")


@register
def chunk_stats_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = derived.text_table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return chunk_documents(documents).groupBy("source").agg(
        F.count(F.lit(1)).alias("n_chunks"),
        F.count_if(F.col("chunk_no") == 0).alias("n_documents"),
        F.sum(F.length("text")).alias("n_chars"),
        F.max("chunk_no").alias("last_chunk"),
    )


@register
def content_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    return derived.text_table(spark, sf_dir, "documents").groupBy("source").agg(
        F.count_if(~is_blank(text)).alias("loaded"),
        F.count_if(is_blank(text)).alias("skipped"),
        F.sum(F.length(text)).alias("raw_chars"),
        F.sum(F.length(strip(text))).alias("stripped_chars"),
    )


@register
def document_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived.documents(spark, sf_dir).select(
        "collection", "doc_key", "content_hash", "file_path", "url", "source", "doc_type",
        language_tag(F.col("file_path"), "none").alias("file_language"),
        hit_label(F.col("file_path"), F.col("url"), F.col("source"), F.col("doc_type")).alias("label"),
    )


@register
def source_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    def part(name: str, key: Column) -> DataFrame:
        return derived.table(spark, sf_dir, name).select(
            F.concat_ws("|", F.lit(name), key).alias("doc_key"), "text",
            content_hash(F.col("text")).alias("content_hash"), F.lit(name).alias("source"),
        )

    together = union_documents(
        part("documents", F.col("doc_id").cast("string")),
        part("benchmark", F.col("item_id").cast("string")),
        part("conversations", F.concat_ws(".", F.col("conv_id").cast("string"), F.col("turn").cast("string"))),
    )
    return together.where(~is_blank(F.col("text"))).select("source", "doc_key", "content_hash")


# Pages and links.


def _parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return parse_pages(scan_pages(spark, f"{sf_dir}/pages.parquet"))


@register
def page_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parsed(spark, sf_dir).where("kept").select("page_id", "main_text")


@register
def page_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parsed(spark, sf_dir).select("page_id", "url", "title")


@register
def page_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    host = F.regexp_extract("url", r"^[a-z]+://([^/?#]*)", 1)
    return documents_from_pages(_parsed(spark, sf_dir), host).select(
        "collection", "doc_key", "content_hash", "url", "title", "source"
    )


@register
def page_link_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_links(_parsed(spark, sf_dir))


@register
def link_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distinct_targets(_parsed(spark, sf_dir))


@register
def url_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.col("url")
    return derived.table(spark, sf_dir, "pages").select(
        "page_id", canonical(url).alias("canonical"), site_base(url).alias("base")
    )


@register
def crawl_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Crawl of the page snapshot, starting from every page of it."""
    parsed = _parsed(spark, sf_dir)
    return reachable(parsed, derived.table(spark, sf_dir, "pages").select("url"))


@register
def crawl_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents reached from the first page of every site."""
    ship_package(spark)
    pages = scan_pages(spark, f"{sf_dir}/pages.parquet")
    seeds = pages.groupBy(site_base(F.col("url"))).agg(F.min("url").alias("url")).select("url")
    return crawled_documents(pages, seeds).select("doc_key", "title", "source", "content_hash")


def _turns(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Conversations as linked pages: each turn links to the next two and to its opening; and the openings.

    Short turns are dropped pages: visited, but not followed.
    """
    def place(turn: Column) -> Column:
        return F.concat_ws("/", F.col("conv_id").cast("string"), turn.cast("string"))

    turns = derived.table(spark, sf_dir, "conversations")
    pages = turns.select(
        place(F.col("turn")).alias("url"),
        (F.length("text") >= 100).alias("kept"),
        F.array(place(F.col("turn") + 1), place(F.col("turn") + 2), place(F.lit(0))).alias("targets"),
    )
    return pages, turns.select(place(F.lit(0)).alias("url"))


@register
def reachable_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages, openings = _turns(spark, sf_dir)
    return reachable(pages, openings)


@register
def recrawled_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from a crawl of other pages: some turns were missing, some not followed, and some led elsewhere."""
    pages, openings = _turns(spark, sf_dir)
    pages = stored(pages, "pages")
    kind = F.pmod(F.xxhash64("url"), F.lit(11))
    before = stored(pages.where(kind != 0).withColumn("kept", F.when(kind == 1, ~F.col("kept")).otherwise(F.col("kept"))).withColumn(
        "targets", F.when(kind == 2, F.array(F.concat("url", F.lit("/gone")))).otherwise(F.col("targets"))), "before")
    done = Crawled(before, stored(links_of(before), "links"), openings, stored(reachable(before, openings), "visited"))
    return recrawl(done, pages.where(kind <= 2))


# Queries, registry and files.


@register
def query_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    models = F.explode(F.array(*[F.lit(model) for model in derived.MODELS]))
    asked = derived.queries(spark, sf_dir).withColumn("model", models)
    return asked.select(
        "query_id", "model", format_query(F.col("query"), F.col("model")).alias("formatted"),
        result_count(F.col("n_results")).alias("k"),
    )


@register
def registry_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = derived.registry(spark, sf_dir)
    default = registry_defaults(select_sources(entries)).withColumn("selection", F.lit("default"))
    wide = select_sources(entries, max_priority=3, include_prerequisites=True)
    return default.unionByName(registry_defaults(wide).withColumn("selection", F.lit("wide")))


@register
def registry_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registry written as JSON documents, an entry each, and scanned."""
    folder = scratch_path(spark, "registry")
    entries = derived.registry(spark, sf_dir)
    document = entries.select(F.array(F.struct(*entries.columns)).alias("sources"))
    document.write.option("maxRecordsPerFile", 1).json(folder)
    return scan_registry(spark, folder)


def _text_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All texts written as a tree of files per source and language; its roots."""
    tree = scratch_path(spark, "tree")
    texts = derived.text_table(spark, sf_dir, "documents").select("source", "lang", "text")
    texts.write.partitionBy("source", "lang").text(tree)
    return texts.select("source").distinct().select(
        "source", F.concat(F.lit(f"{tree}/source="), "source").alias("root")
    )


@register
def tree_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tree of texts read in pieces that may begin and end anywhere."""
    manifest = list_files(_text_tree(spark, sf_dir))
    pieces = read_pieces(manifest, suffix(F.col("file_path")) == ".txt", 10_007)
    lines = F.regexp_count(F.decode("content", "ISO-8859-1"), F.lit("\n"))
    return pieces.groupBy("source", F.regexp_extract("file_path", "^lang=([^/]*)/", 1).alias("lang")).agg(
        F.sum(F.octet_length("content")).alias("n_bytes"), F.sum(lines).alias("n_lines"),
        F.count("error").alias("n_unreadable"),
    )


@register
def tree_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tree of texts, listed and read."""
    roots = _text_tree(spark, sf_dir)
    scanned = scan_files(roots, suffix(F.col("file_path")) == ".txt")
    text = decode_utf8(F.col("content"))
    return scanned.groupBy("source", F.regexp_extract("file_path", "^lang=([^/]*)/", 1).alias("lang")).agg(
        F.sum(F.octet_length("content")).alias("n_bytes"), F.sum(F.length(text)).alias("n_chars")
    )


@register
def branch_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preferred_branch(derived.branches(spark, sf_dir))


@register
def file_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each collection makes of each file."""
    outcomes = file_outcomes(derived.files(spark, sf_dir), *PROFILES)
    return outcomes.select("source", "file_path", suffix(F.col("file_path")).alias("suffix"), *PROFILES)


@register
def file_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents all four collections take from the file corpus."""
    selected = select_sources(
        derived.registry(spark, sf_dir), max_priority=3, include_prerequisites=True
    ).withColumn("name", F.regexp_replace("name", "^team/", ""))
    files = with_registry(derived.files(spark, sf_dir), selected, keep_others=True)
    return documents_from_files(files, *PROFILES).drop("text", "url", "title")


@register
def file_ingest_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest_stats(derived.files(spark, sf_dir), *PROFILES)


# Embedding, the index and search.


@register
def embed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Non-zero weights of every chunk's vector."""
    documents = derived.text_table(spark, sf_dir, "documents").select("doc_id", "text")
    chunks = chunk_documents(documents)
    vectors = embed_text(chunks, fit_hashed_tfidf(chunks))
    numbered = F.transform("embedding", lambda weight, at: F.struct(at.alias("bucket"), weight.alias("weight")))
    filled = F.filter(numbered, lambda entry: entry["weight"] != 0)
    return vectors.select("doc_id", "chunk_no", F.inline(filled)).withColumn(
        "weight", F.round(F.col("weight").cast("double"), 5))


@register
def embed_documents_mllib(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = derived.text_table(spark, sf_dir, "documents").select("doc_id", "text")
    chunks = chunk_documents(documents)
    return mllib_embed(mllib_tfidf().fit(chunks), chunks).drop("text")


def _search(spark: SparkSession, sf_dir: str) -> DataFrame:
    root, model = derived.index(spark, sf_dir)
    return search(spark, root, derived.queries(spark, sf_dir), model)


def _hits(found: DataFrame) -> DataFrame:
    return found.select(
        "query_id", "collection", "rank", "chunk_id", "chunk_no", "label", "score",
        _millionths(F.col("distance")).alias("distance"),
    )


@register
def search_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hits(_search(spark, sf_dir))


@register
def search_after_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits after the same documents were appended twice."""
    _, model = derived.fitted(spark, sf_dir)
    root = scratch_path(spark, "appended")
    documents = derived.documents(spark, sf_dir)
    for _ in range(2):
        build_index(documents, root, ("code", "docs", "tests", "tutorials"), model, model.name, "append")
    return _hits(search(spark, root, derived.queries(spark, sf_dir), model))


@register
def search_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits over collections that were laid out by cells, then changed: part appended later, part removed and brought back."""
    _, model = derived.fitted(spark, sf_dir)
    root = scratch_path(spark, "laid_out")
    documents = derived.documents(spark, sf_dir)
    late = F.pmod(F.xxhash64("doc_key"), F.lit(5)) == 0
    names = ("code", "docs", "tests", "tutorials")
    build_index(documents.where(~late), root, names, model, model.name)
    for name in names:
        lay_out(spark, root, name, rows_per_cell=32)
    build_index(documents, root, names, model, model.name, "append")
    refresh(_edited(documents), root, "docs", model, model.name)
    refresh(documents, root, "docs", model, model.name)
    return _hits(search(spark, root, derived.queries(spark, sf_dir), model))


@register
def search_compacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits after a refresh to an edited snapshot and back, compacted and laid out anew."""
    _, model = derived.fitted(spark, sf_dir)
    root = scratch_path(spark, "compacted")
    documents = derived.documents(spark, sf_dir)
    names = ("code", "docs", "tests", "tutorials")
    build_index(_edited(documents), root, names, model, model.name)
    for name in names:
        refresh(documents, root, name, model, model.name)
        store.compact(spark, root, name)
        lay_out(spark, root, name, rows_per_cell=64)
    store.vacuum(spark, root)
    return _hits(search(spark, root, derived.queries(spark, sf_dir), model))


@register
def search_reembedded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of collections that were built with another model and given this one afterwards."""
    _, model = derived.fitted(spark, sf_dir)
    root, names = scratch_path(spark, "reembedded"), ("code", "docs", "tests", "tutorials")
    other = HashedTfIdf((1.0,) * len(model.weights))
    build_index(derived.documents(spark, sf_dir), root, names, other, other.name)
    for name in names:
        reembed(spark, root, name, model, model.name, buckets_per_job=8)
    return _hits(search(spark, root, derived.queries(spark, sf_dir), model))


@register
def search_rendered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A text for every query, with or without hits."""
    root, model = derived.index(spark, sf_dir)
    return search_text(spark, root, derived.queries(spark, sf_dir), model, derived.KNOWN)


def _statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    root, _ = derived.index(spark, sf_dir)
    return query_status(
        derived.queries(spark, sf_dir), _search(spark, sf_dir), store.catalog(spark, root), derived.known_names(spark))


@register
def search_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _statuses(spark, sf_dir)


@register
def search_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage(_statuses(spark, sf_dir))


@register
def index_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    root, _ = derived.index(spark, sf_dir)
    return collection_counts(store.catalog(spark, root), derived.known_names(spark))


@register
def index_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    root, _ = derived.index(spark, sf_dir)
    return health(store.catalog(spark, root), derived.known_names(spark))


def _edited(documents: DataFrame) -> DataFrame:
    """A later snapshot: French texts edited, one source gone, German keys renamed."""
    text = F.when(F.col("language") == "fr", F.concat("text", F.lit(" edited"))).otherwise(F.col("text"))
    key = F.when(F.col("language") == "de", F.concat("doc_key", F.lit("-new"))).otherwise(F.col("doc_key"))
    return (
        documents.where("source <> 'src3'")
        .withColumn("text", text)
        .withColumn("doc_key", key)
        .withColumn("content_hash", content_hash(F.col("text")))
    )


@register
def refresh_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = derived.documents(spark, sf_dir)
    return changes(documents, _edited(documents))


def _one_collection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived.documents(spark, sf_dir).withColumn("collection", F.lit("docs"))


def _content(spark: SparkSession, root: str) -> DataFrame:
    # Texts and vectors are told by hash and width before the rows meet the keys that are gone.
    told = [content_hash(F.col("text")).alias("text_hash"), F.size("embedding").alias("dims")]
    return store.ensure_index(spark, root, told).select("collection", "doc_key", "chunk_no", "text_hash", "dims")


@register
def refresh_applied(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index after a build and a refresh to the edited snapshot."""
    _, model = derived.fitted(spark, sf_dir)
    root = scratch_path(spark, "refreshed")
    documents = _one_collection(spark, sf_dir)
    build_index(documents, root, ["docs"], model, model.name)
    refresh(_edited(documents), root, "docs", model, model.name)
    return _content(spark, root)


@register
def refresh_streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index after two rounds of the stream: all documents, then the edited ones."""
    _, model = derived.fitted(spark, sf_dir)
    root, folder, progress = (scratch_path(spark, name) for name in ("streamed", "inbox", "progress"))
    documents = _one_collection(spark, sf_dir)
    for snapshot in (documents, _edited(documents)):
        snapshot.write.mode("append").parquet(folder)
        stream_refresh(spark, folder, root, "docs", model, model.name, progress).awaitTermination()
    return _content(spark, root)


@register
def rebuild_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Append to three collections, rebuild one from edited documents, empty another."""
    _, model = derived.fitted(spark, sf_dir)
    root = scratch_path(spark, "rebuilt")
    documents = derived.documents(spark, sf_dir)
    chunks = chunks_of(documents)
    store.write_index(chunks, root, ("code", "docs", "tests"), model.name, "append")
    store.write_index(chunks_of(_edited(documents)), root, ["docs"], model.name, "rebuild")
    store.write_index(chunks.where("false"), root, ["tests"], model.name, "rebuild")
    return _content(spark, root).drop("dims")
