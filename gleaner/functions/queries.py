"""Query formatting, result counts, scores, labels and rendering."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from gleaner.functions.text import strip
from gleaner.schema import DEFAULT_RESULTS, MAX_RESULTS, TOOLS

# The retrieval prefix a model family expects.
SENTENCE_PREFIX = "Represent this sentence for searching relevant passages: "
QUERY_PREFIX = "query: "

# The rule between rendered hits.
HIT_RULE = "\n\n---\n\n"

# The answers to queries without hits.
EMPTY_INDEX = "Index is available but empty. Run the matching index script first."
NO_RESULTS = "No results found."


def format_query(query: Column, model: Column) -> Column:
    """Prefix ``query`` as the named model expects; families are tested in order."""
    name = F.lower(model)
    wants_query = (
        F.contains(name, F.lit("e5"))
        | F.contains(name, F.lit("gte-"))
        | F.contains(name, F.lit("snowflake-arctic"))
    )
    return (
        F.when(F.contains(name, F.lit("mxbai")), F.concat(F.lit(SENTENCE_PREFIX), query))
        .when(wants_query, F.concat(F.lit(QUERY_PREFIX), query))
        .otherwise(query)
    )


def tool_collection(tool: Column) -> Column:
    """Collection that a search tool reads; NULL for an unknown tool."""
    return reduce(
        lambda rest, entry: rest.when(tool == entry[0], F.lit(entry[1])), TOOLS.items(), F
    )


def result_count(n_results: Column) -> Column:
    """Requested hits: five unless given, twenty at most, none below one."""
    wanted = F.least(F.coalesce(n_results, F.lit(DEFAULT_RESULTS)), F.lit(MAX_RESULTS))
    return F.greatest(wanted, F.lit(0)).cast("int")


def score(distance: Column) -> Column:
    return F.round(F.lit(1.0) - distance, 3)


def _filled(value: Column) -> Column:
    return F.nullif(value, F.lit(""))


def hit_label(file_path: Column, url: Column, source: Column, doc_type: Column) -> Column:
    """Where a hit comes from, with its document type in brackets if it has one."""
    place = F.coalesce(_filled(file_path), _filled(url), source, F.lit("?"))
    return F.when(
        _filled(doc_type).isNotNull(), F.concat(place, F.lit("  ["), doc_type, F.lit("]"))
    ).otherwise(place)


def render_hit(label: Column, hit_score: Column, text: Column) -> Column:
    return F.concat(
        F.lit("**"), label, F.lit("** (score: "), hit_score.cast("string"), F.lit(")\n```\n"),
        strip(text), F.lit("\n```"),
    )


def plain_answer(status: Column, collection: Column, tool: Column) -> Column:
    """The text for a query without hits, by its status; an unknown name is told as it was given."""
    asked = F.when(tool.isNotNull(), F.concat(F.lit("tool: "), tool)).otherwise(
        F.concat(F.lit("collection: "), F.coalesce(collection, F.lit(""))))
    return (
        F.when(status == "unknown", F.concat(F.lit("Unknown "), asked))
        .when(status == "missing", F.concat(F.initcap(collection), F.lit(" index missing.")))
        .when(status == "empty", F.lit(EMPTY_INDEX))
        .when(status == "no_results", F.lit(NO_RESULTS))
    )
