"""What a question asks for, and how candidates are boosted and filtered by it."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidex.operators.extract import tags
from evidex.operators.retrieval import coverage

#: Words that are no query terms.
STOP = """a an the of in on at to for and or but with without by from is are was were be been being do does did what which who
whom how why when where that this these those it its as into about than then there their them they we our you your can could should
would may might will shall not no yes any all some more most less least very much many such effect effects affect affects study
studies research known know tell show shows does doing between during under over after before within across"""
#: What a section adds to a passage's score.
SECTION_PRIOR = {"ABSTRACT": 0.004, "RESULTS": 0.004, "CONCL": 0.004, "DISCUSS": 0.002, "INTRO": -0.002, "METHODS": -0.004}
PER_ENTITY = 0.004


def query_terms(question: Column) -> Column:
    """Words of three characters or more that are not on the stop list; repeats stay."""
    words = F.regexp_extract_all(F.lower(question), F.lit(r"[a-z0-9][a-z0-9\-]+"), F.lit(0))
    return F.filter(words, lambda w: ~w.isin(*sorted(set(STOP.split()))) & (F.length(w) > 2))


def query_entities(question: Column, by_type: Mapping[str, Mapping[str, str]]) -> Column:
    """Entities named in a question, type by type, each type by number of hits."""
    return F.concat(*(tags(question, vocabulary, by_count=True) for vocabulary in by_type.values()))


def expanded(question: Column, entities: Column, synonyms: Mapping[str, Sequence[str]], most: int = 4) -> Column:
    """The question with up to four synonyms of each entity that it does not contain yet."""
    known = F.from_json(F.lit("{" + ", ".join(f'"{k}": [{", ".join(chr(34) + w.lower() + chr(34) for w in dict.fromkeys(v))}]' for k, v in synonyms.items()) + "}"), "map<string,array<string>>")
    low = F.lower(question)
    extra = F.filter(F.flatten(F.transform(entities, lambda e: F.slice(F.coalesce(F.try_element_at(known, e), F.array().cast("array<string>")), 1, most))), lambda w: ~F.contains(low, w))
    return F.when(F.size(extra) > 0, F.concat_ws(" ", question, F.array_join(extra, " "))).otherwise(question)


def boosted(candidates: DataFrame, asked: DataFrame, tagged: DataFrame, each: float = PER_ENTITY) -> DataFrame:
    """Adds a little for every entity that question and passage share; only candidates are looked at.

    ``asked`` has (query, wanted array), ``tagged`` (doc, entities array).
    """
    joined = candidates.join(tagged, "doc").join(asked, "query")
    return joined.select("query", "doc", F.round(F.col("score") + each * F.size(F.array_intersect("wanted", "entities")), 9).alias("score"))


def reranked(candidates: DataFrame, passages: DataFrame, asked: DataFrame) -> DataFrame:
    """Adds a hundredth of the term coverage and what the section is worth.

    ``passages`` has (doc, text, section), ``asked`` (query, terms array).
    """
    prior = F.lit(0.0)
    for section, value in SECTION_PRIOR.items():
        prior = F.when(F.col("section") == section, value).otherwise(prior)
    joined = candidates.join(passages, "doc").join(asked, "query")
    return joined.select("query", "doc", F.round(F.col("score") + 0.01 * coverage(F.col("text"), F.col("terms")) + prior, 9).alias("score"))


def passes(kinds: Sequence[str] = (), wanted: Mapping[str, Sequence[str]] | None = None, year_min: int | None = None, year_max: int | None = None) -> Column:
    """Filter of candidates by kind of study, overlap with paper or passage entities, and years; a null year counts as 0.

    Reads the columns study_type, year, entities, and one array for each key of ``wanted``.
    """
    ok = F.col("study_type").isin(*kinds) if kinds else F.lit(True)
    for name, values in (wanted or {}).items():
        ok &= F.arrays_overlap(F.array_union(F.coalesce(name, F.array().cast("array<string>")), F.col("entities")), F.array(*map(F.lit, values)))
    year = F.coalesce("year", F.lit(0))
    if year_min:
        ok &= year >= year_min
    if year_max:
        ok &= year <= year_max
    return ok
