"""Queries of question understanding, extraction, sections and answers, each with its SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidex.functions.lineage import stored
from evidex.operators import extract as X
from evidex.operators import likeness as L
from evidex.operators import predict, qa
from evidex.operators import retrieval as R
from evidex.operators import text as T
from evidex.operators import understanding as U
from evidex.plans.claims import CLAIMS_SQL, claims, read
from evidex.plans.corpus_queries import _FIT, DENSE, TERMS, _asking, _dense, _docs

#: Test vocabularies by type, and synonyms of their terms.
BY_TYPE = {"condition": {"of": "of", "was": "was"}, "outcome": {"the": "the", "that": "that", "with": "with"}, "fuel": {"rest": "er|re", "in": "in|an"}}
SYNONYMS = {"of": ("of", "From Off"), "the": ("The", "thing", "those", "these", "them"), "in": ("inside",), "rest": ("rest", "er")}
NORMAL = {"anvil": ("anvil", "anvil"), "size": ("medium", "large|small"), "gear": ("gear wheel", "cog"), "widget": ("wid", "nothing")}
_WS = "regexp_split_to_array(lower({0}), '[^\\p{{L}}\\p{{N}}_-]+')"


def _quoted(xs) -> str:
    return ", ".join(f"'{x}'" for x in xs)


def _by_count(vocabulary, ws: str = "ws") -> str:
    """Ids of a vocabulary by number of hits among words, then as declared."""
    rows = ", ".join(f"{{'n': -len(list_filter({ws}, lambda w: w IN ({_quoted(p.split('|'))}))), 'i': {i}, 'id': '{k}'}}" for i, (k, p) in enumerate(vocabulary.items()))
    return f"list_transform(list_sort(list_filter([{rows}], lambda x: x.n < 0)), lambda x: x.id)"


def _named(vocabulary, ws: str = "ws") -> str:
    return "list_filter([" + ", ".join(f"CASE WHEN len(list_filter({ws}, lambda w: w IN ({_quoted(p.split('|'))}))) > 0 THEN '{k}' END" for k, p in vocabulary.items()) + "], lambda x: x IS NOT NULL)"


_ENTITIES = "list_concat(list_concat({}, {}), {})".format(*(_by_count(v) for v in BY_TYPE.values()))
_KNOWN = "CASE e " + " ".join(f"WHEN '{k}' THEN [{_quoted(list(dict.fromkeys(x.lower() for x in v))[:4])}]" for k, v in SYNONYMS.items()) + " ELSE CAST([] AS VARCHAR[]) END"
_CAND = f"WITH {DENSE}, q AS (SELECT CAST(doc_id // 100 + 1 AS INT) AS query, text AS qtext FROM documents WHERE doc_id % 100 = 0)"


def _questions(s, d):
    return read(s, d, "conversations").where("role = 'user'").select("conv_id", "turn", "text")


def _tagged(s, d):
    return _docs(s, d).select(F.col("doc_id").alias("doc"), X.tags(F.col("text"), TERMS).alias("entities"))


def _filtered(s, d):
    papers = _docs(s, d).select(F.col("doc_id").alias("doc"), F.col("source").alias("study_type"), F.array("lang").alias("langs"), F.when(F.col("doc_id") % 7 != 0, (F.col("doc_id") % 30 + 1990).cast("int")).alias("year"), X.tags(F.col("text"), TERMS).alias("entities"))
    return _dense(s, d).join(papers, "doc").where(U.passes((), {"langs": ("fr", "than")}, 1995, 2015)).select("query", "doc")


def _logs(s, d):
    """Reports of one line, made from orders."""
    k = F.col("o_orderkey")
    unit = F.when(k % 3 == 0, " s").when(k % 3 == 1, " min").otherwise("-hours")
    text = F.concat(
        F.lit("Run "), k % 97, F.lit(" took 3 hours on the ground, which is a long way and a long while from any sort of rest for the crew that stood by. Then a sample burned for "), k % 41, unit, F.lit(" in free fall at "), k % 31, F.lit(" % O2 and "),
        k % 7 * 20, F.lit(" kPa; later "), k % 31, F.lit(" % O2, "), k % 29, F.lit(" % O2 and "), k % 29, F.lit(" % O2. STS-"), k % 130, F.lit(" and SAFFIRE "), k % 5, F.lit(" and STS-"), k % 130, F.lit(" flew, THEN IN ALL OF THE HALLS AND ROOMS AROUND MIST IN ALL OF THE HALLS AND ROOMS AROUND IT."),
    )
    return read(s, d, "orders").select(k.alias("id"), text.alias("text"))


_LOGS = """WITH o AS (SELECT CAST(o_orderkey AS BIGINT) AS k FROM orders), r AS (SELECT k AS id, 'Run ' || k % 97 || ' took 3 hours on the ground, which is a long way and a long while from any sort of rest for the crew that stood by. Then a sample burned for ' || k % 41 || CASE k % 3 WHEN 0 THEN ' s' WHEN 1 THEN ' min' ELSE '-hours' END || ' in free fall at ' || k % 31 || ' % O2 and '
  || k % 7 * 20 || ' kPa; later ' || k % 31 || ' % O2, ' || k % 29 || ' % O2 and ' || k % 29 || ' % O2. STS-' || k % 130 || ' and SAFFIRE ' || k % 5 || ' and STS-' || k % 130 || ' flew, THEN IN ALL OF THE HALLS AND ROOMS AROUND MIST IN ALL OF THE HALLS AND ROOMS AROUND IT.' AS text FROM o)"""
_MATCHES = r"""list_transform(range(1, len(regexp_extract_all(text, '{0}')) + 1), lambda i: {{'m': regexp_extract_all(text, '{0}')[i],
  'p': list_sum(list_transform(regexp_split_to_array(text, '{0}')[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(regexp_extract_all(text, '{0}')[1:i-1], lambda x: length(x))), 0)}})"""
_DUR = r"(?i)\b\d{1,4}(?:\.\d{1,2})?[- ]?(?:s|sec|seconds?|min|minutes?|hours?|hrs?)\b"
_CUE = X.GRAVITY_CUE
_MODE = "list_reverse_sort(list_transform(list_distinct({0}), lambda v: {{'n': len(list_filter({0}, lambda x: x = v)), 'p': -list_position({0}, v), 'v': v}}))[1].v"
_EXP = r"\b(?:SAFFIRE \d|MIST)\b"

#: Documents with headings, by the remainder of their id.
_HEADED = """h AS (SELECT doc_id AS doc, CASE doc_id % 4 WHEN 0 THEN text WHEN 1 THEN 'Summary' || chr(10) || text WHEN 2 THEN '1. Introduction' || chr(10) || text || chr(10) || '2.1 Results and Discussion' || chr(10) || text || chr(10) || 'References' || chr(10) || text
  ELSE 'INTRODUCTION' || chr(10) || text || chr(10) || 'Acknowledgments' || chr(10) || 'thanks to all of them' END AS text FROM documents),
b AS (SELECT doc, unnest(string_split(regexp_replace(text, '(\\w)-\\n(\\w)', '\\1\\2', 'g'), chr(10))) AS block, generate_subscripts(string_split(regexp_replace(text, '(\\w)-\\n(\\w)', '\\1\\2', 'g'), chr(10)), 1) - 1 AS pos FROM h),
t0 AS (SELECT doc, pos, trim(block) AS block, lower(regexp_replace(trim(block), '^\\s*(?:\\d+(?:\\.\\d+)*\\.?|[IVX]+\\.)?\\s*', '')) AS low FROM b WHERE trim(block) <> ''),
m AS (SELECT doc, pos, block, CASE WHEN length(block) < 70 THEN CASE """.replace("\\\\", "\\") + " ".join(f"WHEN regexp_matches(low, '^(?:{p})[a-z ,&]*[:.]?$') THEN '{k}'" for p, k in T.HEADINGS) + """ END END AS head FROM t0),
k AS (SELECT *, CASE WHEN head IS NULL THEN len(string_split(block, ' ')) ELSE 0 END AS words FROM m),
t AS (SELECT *, coalesce(last_value(head IGNORE NULLS) OVER w, 'BODY') AS kind, coalesce(sum(words) OVER (PARTITION BY doc ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS so_far FROM k WINDOW w AS (PARTITION BY doc ORDER BY pos ROWS UNBOUNDED PRECEDING)),
u AS (SELECT *, coalesce(max(CASE WHEN head = 'REFS' AND so_far > 300 THEN 1 ELSE 0 END) OVER (PARTITION BY doc ORDER BY pos ROWS UNBOUNDED PRECEDING), 0) AS stop FROM t),
sec AS (SELECT doc, pos, kind, words, block FROM u WHERE stop = 0 AND so_far < 15000 AND head IS NULL AND kind NOT IN ('SKIP', 'REFS')),
r1 AS (SELECT *, CASE WHEN kind <> 'BODY' THEN kind WHEN bool_or(kind <> 'BODY') OVER (PARTITION BY doc) THEN 'INTRO' ELSE 'DISCUSS' END AS named FROM sec),
r2 AS (SELECT *, bool_or(named IN ('RESULTS', 'DISCUSS', 'CONCL')) OVER (PARTITION BY doc) AS argued, sum(CASE WHEN named = 'INTRO' THEN 1 ELSE 0 END) OVER (PARTITION BY doc ORDER BY pos ROWS UNBOUNDED PRECEDING) AS nth FROM r1),
labelled AS (SELECT doc, pos, words, block, CASE WHEN NOT argued AND named = 'INTRO' AND nth > 2 THEN 'DISCUSS' ELSE named END AS kind FROM r2)"""
_ABSTRACTS = """, papers AS (SELECT doc_id AS doc, source AS title, CASE WHEN doc_id % 3 = 0 THEN lang || ' abstract &amp;  more' END AS abstract FROM documents UNION ALL SELECT -5, ' A  title ', NULL),
cl AS (SELECT doc, trim(regexp_replace(replace(title, '&amp;', '&'), '\\s+', ' ', 'g')) AS title, trim(regexp_replace(replace(coalesce(abstract, ''), '&amp;', '&'), '\\s+', ' ', 'g')) AS abstract FROM papers),
both_ AS (SELECT l.doc, l.pos, l.kind, l.block FROM labelled l LEFT JOIN cl USING (doc) WHERE NOT (coalesce(abstract <> '', false) AND kind = 'ABSTRACT') UNION ALL SELECT doc, -1, 'ABSTRACT', abstract FROM cl WHERE abstract <> ''),
whole AS (SELECT * FROM both_ UNION ALL SELECT doc, -1, 'ABSTRACT', title FROM cl WHERE doc NOT IN (SELECT doc FROM both_))""".replace("\\\\", "\\")


def _headed(s, d):
    nl, text, k = F.lit("\n"), F.col("text"), F.col("doc_id") % 4
    bound = (
        F.when(k == 0, text).when(k == 1, F.concat(F.lit("Summary"), nl, text))
        .when(k == 2, F.concat(F.lit("1. Introduction"), nl, text, nl, F.lit("2.1 Results and Discussion"), nl, text, nl, F.lit("References"), nl, text))
        .otherwise(F.concat(F.lit("INTRODUCTION"), nl, text, nl, F.lit("Acknowledgments"), nl, F.lit("thanks to all of them")))
    )
    return T.relabelled(T.sections(T.paragraphs(_docs(s, d).select("doc_id", bound.alias("text")))))


def _reports(s, d):
    """Documents as reports: lines parted by blank ones, with headings, a caption, a table's remains and sources, by the remainder of the id."""
    nl, k = F.lit("\n\n"), F.col("doc_id") % 5
    lined = F.regexp_replace("text", "\n", "\n\n")
    caption, contents, remains = F.lit("Figure 3. What was seen by all of those who looked at it."), F.lit("Results ......... 12 and Discussion ......... 14 and more"), F.lit("12.5 13.6 14.7 15.8 | 16.9 17.0 18.1 a b 19.2 20.3 21.4")
    bound = (
        F.when(k == 0, lined).when(k == 1, F.concat(F.lit("1. Introduction"), nl, lined, nl, F.lit("2.1 Results and Discussion:\n"), lined, nl, caption, nl, F.lit("References"), nl, lined))
        .when(k == 2, F.concat(contents, nl, F.lit("ABSTRACT"), nl, lined, nl, remains, nl, F.lit("IV) Experimental setup"), nl, lined)).when(k == 3, F.concat(F.lit("Background"), nl, lined, nl, F.lit("Acknowledgements"), nl, lined, nl, F.lit("Conclusions"), nl, caption))
        .otherwise(F.concat(F.lit("Nomenclature"), nl, lined, nl, F.lit("Experiments were made in all of them"), nl, lined))
    )
    return _docs(s, d).select("doc_id", bound.alias("text"))


_HEADS = (("references|bibliography|literature cited", "REFS"), ("acknow.*|nomenclature", "SKIP"), (".*result.*", "RESULTS"), ("abstract|summary", "ABSTRACT"), (".*conclu.*", "CONCL"), (".*(?:discussion|observation).*", "DISCUSS"), ("(?:introduction|background).*", "INTRO"), (".*", "METHODS"))
_PARSED = (
    r"""r AS (SELECT doc_id AS doc, replace(text, chr(10), chr(10) || chr(10)) AS t, 'Figure 3. What was seen by all of those who looked at it.' AS cap, chr(10) || chr(10) AS nl FROM documents),
h AS (SELECT doc, CASE doc % 5 WHEN 0 THEN t WHEN 1 THEN '1. Introduction' || nl || t || nl || '2.1 Results and Discussion:' || chr(10) || t || nl || cap || nl || 'References' || nl || t
  WHEN 2 THEN 'Results ......... 12 and Discussion ......... 14 and more' || nl || 'ABSTRACT' || nl || t || nl || '12.5 13.6 14.7 15.8 | 16.9 17.0 18.1 a b 19.2 20.3 21.4' || nl || 'IV) Experimental setup' || nl || t
  WHEN 3 THEN 'Background' || nl || t || nl || 'Acknowledgements' || nl || t || nl || 'Conclusions' || nl || cap ELSE 'Nomenclature' || nl || t || nl || 'Experiments were made in all of them' || nl || t END AS text FROM r),
b AS (SELECT doc, unnest(regexp_split_to_array(regexp_replace(replace(text, chr(13), ''), '([\p{L}\p{N}_])-
([\p{L}\p{N}_])', '', 'g'), '
\s*
')) AS block, generate_subscripts(regexp_split_to_array(regexp_replace(replace(text, chr(13), ''), '([\p{L}\p{N}_])-
([\p{L}\p{N}_])', '', 'g'), '
\s*
'), 1) AS pos FROM h),
l AS (SELECT doc, pos, list_filter(list_transform(string_split(block, chr(10)), lambda x: trim(x, chr(32) || chr(9))), lambda x: x <> '') AS lines FROM b),
f AS (SELECT doc, pos, lines, CASE WHEN length(lines[1]) < 70 THEN lower(nullif(regexp_extract(lines[1], '(?i)HEADING', 1), '')) END AS head FROM l WHERE len(lines) > 0),
k AS (SELECT doc, pos, head, array_to_string(CASE WHEN head IS NULL THEN lines ELSE lines[2:] END, ' ') AS p, CASE WHEN head IS NOT NULL THEN CASE KINDS END END AS opened FROM f),
s AS (SELECT *, last_value(opened IGNORE NULLS) OVER (PARTITION BY doc ORDER BY pos ROWS UNBOUNDED PRECEDING) AS kind, regexp_matches(p, '(?i)CAPTION') AS caption, length(p) >= 40 AND NOT regexp_matches(p, 'CONTENTS') AND length(regexp_replace(p, '\P{L}', '', 'g')) >= 0.6::DOUBLE * length(replace(p, ' ', '')) AS good FROM k),
g AS (SELECT *, CASE WHEN caption THEN 'FIG' ELSE coalesce(kind, 'BODY') END AS own, CASE WHEN caption THEN p ELSE trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(p, 'NUMBERS', '', 'g'), 'AUTHORS', '', 'g'), 'FIGURES', '', 'g'), '\s+([.,;:])', '', 'g')) END AS block FROM s),
w AS (SELECT *, good AND own NOT IN ('SKIP', 'REFS') AS kept, CASE WHEN good AND own NOT IN ('SKIP', 'REFS') THEN len(regexp_split_to_array(trim(block), '\s+')) ELSE 0 END AS words FROM g),
x AS (SELECT *, coalesce(sum(words) OVER (PARTITION BY doc ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS so_far FROM w),
y AS (SELECT *, coalesce(bool_or(opened = 'REFS' AND so_far > 300) OVER (PARTITION BY doc ORDER BY pos ROWS UNBOUNDED PRECEDING), false) AS over, bool_or(head IS NOT NULL) OVER (PARTITION BY doc) AS headed FROM x),
z AS (SELECT doc, pos, block, words, CASE WHEN own <> 'BODY' THEN own WHEN headed THEN 'INTRO' ELSE 'DISCUSS' END AS named FROM y WHERE kept AND NOT over AND so_far < 15000),
parsed AS (SELECT doc, row_number() OVER (PARTITION BY doc ORDER BY pos) - 1 AS pos, block, words, CASE WHEN named = 'INTRO' AND NOT bool_or(named IN ('RESULTS', 'DISCUSS', 'CONCL')) OVER (PARTITION BY doc) AND sum((named = 'INTRO')::INT) OVER (PARTITION BY doc ORDER BY pos ROWS UNBOUNDED PRECEDING) > 2 THEN 'DISCUSS' ELSE named END AS kind FROM z)"""
    .replace("HEADING", T.HEADING.replace("'", "''")).replace("KINDS", " ".join(f"WHEN regexp_matches(head, '^(?:{p})$') THEN '{k}'" for p, k in _HEADS)).replace("CAPTION", T.CAPTION).replace("CONTENTS", T.CONTENTS)
    .replace("NUMBERS", T.CITED_NUMBERS).replace("AUTHORS", T.CITED_AUTHORS.replace("'", "''")).replace("FIGURES", T.CITED_FIGURES)
)


def _papers(s, d):
    abstract = F.when(F.col("doc_id") % 3 == 0, F.concat("lang", F.lit(" abstract &amp;  more")))
    return _docs(s, d).select(F.col("doc_id").alias("doc"), F.col("source").alias("title"), abstract.alias("abstract")).unionByName(s.createDataFrame([(-5, " A  title ", None)], "doc long, title string, abstract string"))


def _passages(s, d):
    """Sentences of documents as passages: ten documents make the passages of a question."""
    each = T.sentences(_docs(s, d)).where(qa.candidate(F.col("sentence")))
    return each.select(F.floor(F.col("doc") / 10).alias("query"), (F.col("doc") % 10 + 1).cast("int").alias("n"), "pos", "sentence")


def worth(s, d):
    """Scores with two terms asked for; the likeness is left at zero."""
    c = F.col("sentence")
    section = F.when(F.col("n") % 3 == 0, "RESULTS").when(F.col("n") % 3 == 1, "METHODS").otherwise("INTRO")
    hits = F.size(X.tags(c, {"the": "the", "of": "of"}))
    score = qa.sentence_score(c, section, F.col("n"), F.array(F.lit("tion"), F.lit("an")), hits, F.lit(0.0), F.when(F.col("query") % 2 == 0, F.contains(c, F.lit("that"))))
    return _passages(s, d).withColumn("score", score)


def liked(s, d):
    """The scores of :func:`worth` with likeness: each ten documents answer the first user's turn of the dialogue of that number."""
    first = read(s, d, "conversations").where("role = 'user'").groupBy(F.col("conv_id").alias("query")).agg(F.min_by("text", "turn").alias("question"))
    passages = stored(worth(s, d).where("score is not null"))  # five passes read the sentences
    axes = L.leading_axes(passages)
    alike = L.likeness(F.col("sentence"), F.coalesce("question", F.lit("")), axes)
    return passages.join(first, "query", "left").withColumn("likeness", F.round(alike, 4)).withColumn("score", F.round(F.col("score") + 6 * F.col("likeness"), 6)).drop("question")


_SENTENCES = r"""x AS (SELECT doc_id AS doc, unnest(regexp_split_to_array(regexp_replace(text, '([.!?])\s+([A-Z(\[])', '\1' || chr(1) || '\2', 'g'), chr(1))) AS sentence,
  generate_subscripts(regexp_split_to_array(regexp_replace(text, '([.!?])\s+([A-Z(\[])', '\1' || chr(1) || '\2', 'g'), chr(1)), 1) - 1 AS pos FROM documents), st AS (SELECT doc, CAST(pos AS INT) AS pos, trim(sentence) AS sentence FROM x WHERE trim(sentence) <> '')"""
def _answers(s, d):
    turns = read(s, d, "conversations")
    return turns.select((F.col("turn") % 3 != 0).alias("answerable"), (F.length("text") % 5 == 0).alias("refused"), (F.col("conv_id") % 4).alias("citations"), (F.col("turn") % 2).alias("invalid"), (F.length("text") % 100 / 100.0).alias("support"), F.length("text").cast("double").alias("latency"))


def _experiments(s, d):
    """Findings with the share of oxygen, whether it was measured, and where."""
    return claims(s, d).select("paper_id", "condition", (F.col("confidence").cast("double") * 30).alias("oxygen"), (F.col("direction") == "increase").alias("measured"))


QUERIES = {
    "query_terms": (
        lambda s, d: _questions(s, d).select("conv_id", "turn", F.array_join(U.query_terms(F.col("text")), " ").alias("terms")),
        f"SELECT conv_id, turn, array_to_string(list_filter(regexp_extract_all(lower(text), '[a-z0-9][a-z0-9\\-]+'), lambda w: w NOT IN ({_quoted(U.STOP.split())}) AND length(w) > 2), ' ') AS terms FROM conversations WHERE role = 'user'",
    ),
    "query_entities": (
        lambda s, d: _questions(s, d).select("conv_id", "turn", F.array_join(U.query_entities(F.col("text"), BY_TYPE), ",").alias("entities")),
        f"WITH w AS (SELECT *, {_WS.format('text')} AS ws FROM conversations WHERE role = 'user') SELECT conv_id, turn, array_to_string({_ENTITIES}, ',') AS entities FROM w",
    ),
    "query_expansion": (
        lambda s, d: _questions(s, d).select("conv_id", "turn", U.expanded(F.col("text"), U.query_entities(F.col("text"), BY_TYPE), SYNONYMS).alias("question")),
        f"""WITH w AS (SELECT *, {_WS.format('text')} AS ws FROM conversations WHERE role = 'user'), e AS (SELECT *, {_ENTITIES} AS ents FROM w),
        x AS (SELECT *, list_filter(flatten(list_transform(ents, lambda e: {_KNOWN})), lambda y: NOT contains(lower(text), y)) AS extra FROM e)
        SELECT conv_id, turn, CASE WHEN len(extra) > 0 THEN text || ' ' || array_to_string(extra, ' ') ELSE text END AS question FROM x""",
    ),
    "entity_boost": (
        lambda s, d: U.boosted(_dense(s, d).select("query", "doc", "score"), _asking(s, d).select("query", X.tags(F.col("text"), TERMS).alias("wanted")), _tagged(s, d)),
        _CAND + f""", qe AS (SELECT query, {_named(TERMS, _WS.format('qtext'))} AS wanted FROM q), de AS (SELECT doc_id AS doc, {_named(TERMS, _WS.format('text'))} AS entities FROM documents)
        SELECT query, doc, round(score + 0.004::DOUBLE * len(list_intersect(wanted, entities)), 9) AS score FROM den JOIN qe USING (query) JOIN de USING (doc)""",
    ),
    "section_prior": (
        lambda s, d: U.reranked(
            _dense(s, d).select("query", "doc", "score"),
            _docs(s, d).select(F.col("doc_id").alias("doc"), "text", F.element_at(F.array(*map(F.lit, ("ABSTRACT", "RESULTS", "METHODS", "INTRO", "DISCUSS"))), (F.col("doc_id") % 5 + 1).cast("int")).alias("section")),
            _asking(s, d).select("query", F.slice(R.tokens(F.col("text")), 1, 5).alias("terms")),
        ),
        _CAND + """, qt AS (SELECT query, list_filter(regexp_split_to_array(lower(qtext), '[^a-z0-9]+'), lambda w: length(w) >= 2)[1:5] AS terms FROM q)
        SELECT query, doc, round(score + 0.01::DOUBLE * (len(list_filter(terms, lambda t: contains(lower(text), substr(t, 1, 6)))) / greatest(len(terms), 1)) + [0.004, 0.004, -0.004, -0.002, 0.002][doc % 5 + 1]::DOUBLE, 9) AS score FROM den JOIN qt USING (query) JOIN documents ON doc_id = doc""",
    ),
    "post_filter": (
        _filtered,
        _CAND + f""", p AS (SELECT doc_id AS doc, lang, CASE WHEN doc_id % 7 <> 0 THEN 1990 + doc_id % 30 END AS year, {_named(TERMS, _WS.format('text'))} AS entities FROM documents)
        SELECT query, doc FROM den JOIN p USING (doc) WHERE (lang = 'fr' OR list_contains(entities, 'than')) AND coalesce(year, 0) BETWEEN 1995 AND 2015""",
    ),
    "normalised_names": (
        lambda s, d: read(s, d, "part").select("p_partkey", X.normalised(F.when(F.col("p_partkey") % 9 == 0, "size").when(F.col("p_partkey") % 9 == 1, "wheel").when(F.col("p_partkey") % 9 == 2, "").otherwise(F.col("p_name")), NORMAL).alias("entity")),
        f"""WITH r AS (SELECT p_partkey, CASE p_partkey % 9 WHEN 0 THEN 'size' WHEN 1 THEN 'wheel' WHEN 2 THEN '' ELSE p_name END AS raw FROM part), w AS (SELECT *, {_WS.format('raw')} AS ws FROM r)
        SELECT p_partkey, CASE WHEN raw = '' THEN NULL WHEN raw IN ({_quoted(NORMAL)}) THEN raw ELSE coalesce({_by_count({k: p for k, (_, p) in NORMAL.items()})}[1], """
        + ", ".join(f"CASE WHEN contains(lower(raw), '{label}') OR contains('{label}', lower(raw)) THEN '{k}' END" for k, (label, _) in NORMAL.items()) + ") END AS entity FROM w",
    ),
    "stated_durations": (
        lambda s, d: _logs(s, d).select("id", X.seconds_of(F.col("text"), F.when(F.col("id") % 2 == 0, F.array(F.lit("drop_tower"), F.lit("parabolic"))).otherwise(F.array().cast("array<string>")), F.col("id") % 11 == 0).alias("x")).where("x is not null").select("id", "x.seconds", "x.inferred"),
        _LOGS + rf""", m AS (SELECT id, text, unnest({_MATCHES.format(_DUR)}) AS x FROM r),
        v AS (SELECT id, x.p AS p, CAST(regexp_extract(x.m, '^(\d+(?:\.\d+)?)', 1) AS DOUBLE) * CASE lower(regexp_extract(x.m, '([A-Za-z]+)$', 1)) WHEN 's' THEN 1 WHEN 'min' THEN 60 ELSE 3600 END AS seconds,
          regexp_matches(substr(text, CAST(greatest(x.p - 60, 0) + 1 AS BIGINT), CAST(x.p + length(x.m) + 60 - greatest(x.p - 60, 0) AS BIGINT)), '{_CUE}') AS near FROM m),
        f AS (SELECT id, min_by(seconds, p) AS seconds FROM v WHERE near AND seconds BETWEEN 0.5 AND 2592000 GROUP BY id)
        SELECT * FROM (SELECT r.id, coalesce(f.seconds, CASE WHEN r.id % 11 = 0 THEN 3600 WHEN r.id % 2 = 0 THEN 20 END) AS seconds, f.seconds IS NULL AS inferred FROM r LEFT JOIN f USING (id)) WHERE seconds IS NOT NULL""",
    ),
    "missions_named": (
        lambda s, d: _logs(s, d).select("id", F.array_join(X.mentioned(F.col("text"), r"\bSTS-\d+|SAFFIRE\s+\d", 6), ",").alias("missions"), F.array_join(X.experiments(F.col("text"), _EXP), ",").alias("experiments")),
        _LOGS + r" SELECT id, 'STS-' || id % 130 || ',SAFFIRE ' || id % 5 AS missions, 'SAFFIRE-' || id % 5 AS experiments FROM r",
    ),
    "atmospheres": (
        lambda s, d: _logs(s, d).select("id", X.atmosphere(F.col("text")).alias("atmosphere")),
        _LOGS + rf""", v AS (SELECT id, list_filter(list_transform(regexp_extract_all(text, '(\d+(?:\.\d+)?)\s*% O2', 1), lambda x: CAST(x AS INT)), lambda x: x BETWEEN 10 AND 100) AS o, list_filter(list_transform(regexp_extract_all(text, '(\d+(?:\.\d+)?)\s*kPa', 1), lambda x: CAST(x AS INT)), lambda x: x > 0) AS p FROM r),
        m AS (SELECT id, {_MODE.format('o')} AS o, {_MODE.format('p')} AS p FROM v)
        SELECT id, nullif(concat_ws(', ', o || ' % O2', p || ' kPa'), '') AS atmosphere FROM m""",
    ),
    "limitations": (
        lambda s, d: X.limitations(T.sentences(_docs(s, d)).withColumn("kind", F.when(F.col("doc") % 2 == 0, "DISCUSS").otherwise("INTRO")), "tion"),
        f"WITH {_SENTENCES} SELECT doc, row_number() OVER (PARTITION BY doc ORDER BY pos) AS rank, sentence FROM st WHERE doc % 2 = 0 AND length(sentence) BETWEEN 40 AND 500 AND contains(sentence, 'tion') QUALIFY rank <= 3",
    ),
    "findings_of_originals": (
        lambda s, d: X.without_duplicates(claims(s, d), read(s, d, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 5 == 0, F.col("o_orderkey") - 1).alias("duplicate_of"))).groupBy("paper_id").agg(F.count("*").alias("n")),
        f"WITH {CLAIMS_SQL} SELECT paper_id, count(*) AS n FROM claims WHERE paper_id % 5 <> 0 GROUP BY paper_id",
    ),
    "section_kinds": (
        lambda s, d: _headed(s, d).groupBy("doc", "kind").agg(F.count("*").alias("n"), F.sum("words").alias("words")),
        f"WITH {_HEADED} SELECT doc, kind, count(*) AS n, CAST(sum(words) AS BIGINT) AS words FROM labelled GROUP BY ALL",
    ),
    "section_labels": (
        lambda s, d: _headed(s, d).where(T.good_block(F.col("block"))).groupBy("kind").agg(F.count("*").alias("n"), F.sum("words").alias("words")),
        rf"WITH {_HEADED} SELECT kind, count(*) AS n, CAST(sum(words) AS BIGINT) AS words FROM labelled WHERE NOT regexp_matches(block, '\.{{5,}}') AND length(block) >= 40 AND length(regexp_replace(block, '[^\p{{L}}]', '', 'g')) >= 0.6 * length(regexp_replace(block, '\s', '', 'g')) GROUP BY kind",
    ),
    "report_sections": (
        lambda s, d: T.report_sections(_reports(s, d)).select("doc", "pos", "kind", F.md5(F.col("block").cast("binary")).alias("digest")),
        f"WITH {_PARSED} SELECT doc, CAST(pos AS INT) AS pos, kind, md5(block) AS digest FROM parsed",
    ),
    "report_chunks": (
        lambda s, d: T.report_chunks(_reports(s, d)).groupBy("doc", "kind").agg(F.sum(F.size(F.split("text", " "))).alias("words")),
        f"WITH {_PARSED} SELECT doc, kind, CAST(sum(words) AS BIGINT) AS words FROM parsed GROUP BY ALL",
    ),
    "section_histogram": (
        lambda s, d: _headed(s, d).groupBy("kind").agg(F.count("*").alias("n"), F.count_distinct("doc").alias("docs")),
        f"WITH {_HEADED} SELECT kind, count(*) AS n, count(DISTINCT doc) AS docs FROM labelled GROUP BY kind",
    ),
    "abstract_precedence": (
        lambda s, d: T.with_abstract(_headed(s, d), _papers(s, d)).groupBy("doc", "kind").agg(F.count("*").alias("n"), F.sum(F.length("block")).alias("chars")),
        f"WITH {_HEADED}{_ABSTRACTS} SELECT doc, kind, count(*) AS n, CAST(sum(length(block)) AS BIGINT) AS chars FROM whole GROUP BY ALL",
    ),
    "full_text_flags": (
        lambda s, d: T.sizes(T.with_abstract(_headed(s, d), _papers(s, d)), _papers(s, d)),
        rf"WITH {_HEADED}{_ABSTRACTS} SELECT doc, CAST(sum(len(regexp_split_to_array(trim(block), '\s+'))) AS BIGINT) AS word_count, sum(length(block) + 1) - 1 > 2 * greatest(max(length(abstract)), 400) AS full_text FROM whole JOIN cl USING (doc) GROUP BY doc",
    ),
    "sentence_worth": (
        lambda s, d: worth(s, d).select("query", "n", "pos", "score"),
        rf"""WITH {_SENTENCES}, p AS (SELECT doc // 10 AS query, CAST(doc % 10 + 1 AS INT) AS n, pos, sentence, lower(sentence) AS low, {_WS.format('sentence')} AS ws FROM st WHERE {_FIT}),
        c AS (SELECT *, (contains(low, 'tion')::INT + contains(low, 'an')::INT) / 2.0::DOUBLE AS cov, list_contains(ws, 'the')::INT + list_contains(ws, 'of')::INT AS ents, greatest({', '.join(f"regexp_matches(sentence, '{p}')::INT" for p in qa.EFFECT)}) AS effect FROM p)
        SELECT query, n, pos, CASE WHEN cov > 0 OR ents > 0 THEN round(1.2::DOUBLE * cov + 0.35::DOUBLE * least(ents, 3) + 0.6::DOUBLE * effect + 0.4::DOUBLE * regexp_matches(sentence, '{qa.CUE}')::INT + CASE n % 3 WHEN 0 THEN 0.3 WHEN 1 THEN -0.3 ELSE 0 END::DOUBLE - 0.03::DOUBLE * n
          - regexp_matches(sentence, '{qa.BACKGROUND}')::INT - 0.8::DOUBLE * regexp_matches(sentence, '{qa.METHOD}')::INT - 0.35::DOUBLE * regexp_matches(sentence, '{qa.DANGLING}')::INT + CASE WHEN query % 2 <> 0 THEN 0 WHEN contains(sentence, 'that') THEN 0.5 ELSE -0.7 END::DOUBLE, 6) + 0 END AS score FROM c""",
    ),
    "answer_selection": (lambda s, d: qa.selected(worth(s, d)), None),
    "sentence_likeness": (lambda s, d: liked(s, d).select("query", "n", "pos", "likeness", "score"), None),
    "answer_metrics": (
        lambda s, d: qa.answer_metrics(_answers(s, d)),
        """WITH a AS (SELECT turn % 3 <> 0 AS answerable, length(text) % 5 = 0 AS refused, conv_id % 4 AS citations, turn % 2 AS invalid, length(text) % 100 / 100.0::DOUBLE AS support, CAST(length(text) AS DOUBLE) AS latency FROM conversations)
        SELECT count(*) AS n, round(avg((NOT refused)::INT) FILTER (answerable), 3) AS answer_rate, round(avg(refused::INT) FILTER (NOT answerable), 3) AS refusal_accuracy, round(1 - sum(invalid) / sum(citations + invalid), 3) AS citation_validity,
          round(avg(support) FILTER (answerable), 3) AS faithfulness, round(median(latency), 3) AS latency_p50 FROM a""",
    ),
    "answer_confidence": (
        lambda s, d: _answers(s, d).select(qa.confidence(F.col("support"), F.col("citations") / 4, F.col("answerable"), F.col("citations")).alias("score")).groupBy("score", qa.confidence_label(F.col("score")).alias("label")).agg(F.count("*").alias("n")),
        """WITH s AS (SELECT CAST((55 * (length(text) % 100) * 10 + 2500 * (conv_id % 4) // 4 * 10 + 10000 * (turn % 3 <> 0)::INT + 2000 * least(conv_id % 4, 5) + 50) // 100 AS DOUBLE) / 1000 AS score FROM conversations)
        SELECT score, CASE WHEN score >= 0.75 THEN 'high' WHEN score >= 0.5 THEN 'medium' ELSE 'low' END AS label, count(*) AS n FROM s GROUP BY score""",
    ),
    "training_subset": (
        lambda s, d: predict.training_subset(_experiments(s, d), ("Brand#11", "Brand#12", "Brand#21")).groupBy("condition").agg(F.count("*").alias("n")),
        f"WITH {CLAIMS_SQL}, e AS (SELECT condition, direction = 'increase' OR condition IN ('Brand#11', 'Brand#12', 'Brand#21') OR abs(CAST(confidence AS DOUBLE) * 30 - 21) > 0.5 AS fit FROM claims), n AS (SELECT count(*) FILTER (fit) AS n FROM e) SELECT condition, count(*) AS n FROM e CROSS JOIN n WHERE fit OR n.n < 40 GROUP BY condition",
    ),
}
