"""Queries over the text, vector, label and log tables, each with its SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from evidex.functions.lineage import cut
from evidex.functions import formatting
from evidex.operators import dedupe, evaluate, predict, qa
from evidex.operators import extract as X
from evidex.operators import retrieval as R
from evidex.operators import text as T
from evidex.operators.understanding import STOP
from evidex.plans.claims import read
from evidex.sources import export, records
from evidex.streaming import logs

#: Test vocabularies: frequent words of the invented prose.
TERMS = {"tion": "thtion|ertion", "than": "than", "the": "the", "this": "this", "with": "with", "die": "die", "les": "les", "que": "que"}
DOMAIN = {"than": "than", "les": "les", "que": "que"}
#: Endings that stand for directions in the invented prose.
CUES = {"increase": "(?i)ing\\b", "decrease": "(?i)ed\\b", "no_change": "(?i)est\\b"}
OUTCOMES, CONDITIONS = {"the": "the", "that": "that", "with": "with"}, {"of": "of", "was": "was"}
def _docs(s, d):
    return read(s, d, "documents").select("doc_id", "text", "lang", "source", "n_chars")


def _vectors(s, d):
    return read(s, d, "embeddings")


def _dense(s, d):
    asked = _vectors(s, d).where(F.col("vec_id") % 100 == 0).select((F.col("vec_id") / 100 + 1).cast("int").alias("query"), F.col("embedding").alias("v"))
    return R.dense(_vectors(s, d), asked, top=50)


def _asking(s, d):
    """The documents that ask: those whose id is divisible by 100; the query's id is that of the vector beside it."""
    return _docs(s, d).where(F.col("doc_id") % 100 == 0).select((F.col("doc_id") / 100 + 1).cast("int").alias("query"), "text")


def _asked(s, d):
    """The distinct index terms of every document that asks."""
    return _asking(s, d).select("query", F.explode(F.array_distinct(R.index_terms(F.col("text")))).alias("term")).distinct()


def _lexical(s, d):
    return R.bm25(_docs(s, d), _asked(s, d))


def _terms(s, d):
    return _asked(s, d).groupBy("query").agg(F.collect_list("term").alias("terms"))


def _reports(s, d):
    """Reports with author, title and identifier, made of parts of one brand and size."""
    return read(s, d, "part").select(F.col("p_partkey").alias("id"), F.concat(F.col("p_brand"), F.lit(", X.")).alias("author"), F.concat_ws(" ", "p_name", "p_type", F.col("p_size").cast("string")).alias("title"), F.when(F.col("p_size") == 50, F.concat("p_brand", "p_name")).alias("doi"), F.lit(None).cast("string").alias("journal"), (F.col("p_size") + 1950).alias("year"))


_TOK = "list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda w: length(w) >= 2)"
_INDEXED = f"list_filter({_TOK}, lambda w: w NOT IN ({', '.join(repr(w) for w in R.STOP_WORDS.split())}))"
BM25 = f"""WITH asks AS (SELECT CAST(doc_id // 100 + 1 AS INT) AS query, text FROM documents WHERE doc_id % 100 = 0), q AS (SELECT DISTINCT query, unnest({_INDEXED}) AS term FROM asks),
w AS (SELECT doc_id AS doc, {_INDEXED} AS w FROM documents), sz AS (SELECT count(*) AS n, avg(len(w)) AS avgdl FROM w),
p AS (SELECT doc, len(w) AS dl, unnest(w) AS term FROM w), tf AS (SELECT term, doc, dl, count(*) AS tf FROM p WHERE term IN (SELECT term FROM q) GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
sc AS (SELECT query, doc, round(sum(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))), 6) AS score FROM q JOIN tf USING (term) JOIN df USING (term) CROSS JOIN sz GROUP BY ALL),
lex AS (SELECT query, doc, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank FROM sc WHERE score > 0 QUALIFY rank <= 200)"""
DENSE = """dv AS (SELECT CAST(q.vec_id // 100 + 1 AS INT) AS query, e.vec_id AS doc, round(list_sum(list_transform(list_zip(e.embedding, q.embedding), lambda x: x[1]::DOUBLE * x[2]::DOUBLE)), 6) AS score FROM embeddings e CROSS JOIN embeddings q WHERE q.vec_id % 100 = 0),
den AS (SELECT query, doc, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank FROM dv WHERE score > 0 QUALIFY rank <= 50)"""
FUSED = f"""{BM25}, {DENSE}, fused AS (SELECT query, doc, round(sum(1.0::DOUBLE / (60 + rank - 1)), 9) AS score FROM (SELECT query, doc, rank FROM lex UNION ALL SELECT query, doc, rank FROM den) GROUP BY ALL)"""
_RUNS = r"len(list_filter(range(1, len(string_split(sentence, ' ')) - 2), lambda i: regexp_matches(string_split(sentence, ' ')[i], '[a-z0-9]$') AND regexp_matches(string_split(sentence, ' ')[i + 1], '^[A-Z][a-z]+$') AND regexp_matches(string_split(sentence, ' ')[i + 2], '^[a-z]+$')))"
#: Sentences that are fit to quote.
_FIT = rf"length(sentence) BETWEEN 60 AND 420 AND NOT regexp_matches(sentence, '{qa.NOT_A_FINDING}') AND NOT regexp_matches(sentence, '{qa.LISTED}') AND {_RUNS} < 3 AND length(regexp_replace(sentence, '\P{{Lu}}', '', 'g')) <= 0.3::DOUBLE * length(regexp_replace(sentence, '\P{{L}}', '', 'g'))"
_SENT = "SELECT doc_id AS doc, unnest(regexp_split_to_array(regexp_replace(text, '([.!?])\\s+([A-Z(\\[])', '\\1' || chr(1) || '\\2', 'g'), chr(1))) AS sentence"


_SENT_POS = r"""x AS (SELECT doc_id AS doc, unnest(regexp_split_to_array(regexp_replace(text, '([.!?])\s+([A-Z(\[])', '\1' || chr(1) || '\2', 'g'), chr(1))) AS sentence,
  generate_subscripts(regexp_split_to_array(regexp_replace(text, '([.!?])\s+([A-Z(\[])', '\1' || chr(1) || '\2', 'g'), chr(1)), 1) - 1 AS pos FROM documents), st AS (SELECT doc, CAST(pos AS INT) AS pos, trim(sentence) AS sentence FROM x WHERE trim(sentence) <> '')"""


def _ranked_docs(s, d):
    return _lexical(s, d).where("rank <= 10").select("query", "doc", "rank")


def _capped(s, d):
    fused = R.fuse(_lexical(s, d), _dense(s, d))
    return R.capped(fused, _docs(s, d).select(F.col("doc_id").alias("doc"), F.col("source").alias("report")))


def _good(s, d):
    return read(s, d, "labels").where("quality = 1").select(F.col("doc_id").alias("doc")).distinct()


def _relevant(hits, good):
    return hits.select("query", "doc").distinct().join(good, "doc", "left_semi")


def _metrics(s, d):
    ranked = cut(_ranked_docs(s, d))
    return evaluate.rank_metrics(ranked, _relevant(ranked, _good(s, d)), _asking(s, d).select("query"))


def _gate(s, d):
    """Questions name an entity, the domain's sign, if they have one of the test vocabulary's terms."""
    ranked = cut(_ranked_docs(s, d))
    covered = R.rerank(ranked.withColumn("score", F.lit(0.0)), _docs(s, d), _terms(s, d))
    named = _asking(s, d).select("query", (F.size(X.tags(F.col("text"), DOMAIN)) > 0).alias("domain"))
    return qa.refuses(covered.join(ranked, ["query", "doc"]), named)


def _stages(s, d):
    """Means of the ranking metrics for each way of searching, over all queries that ask."""
    lexical, terms, asks = cut(_lexical(s, d)), _terms(s, d), _asking(s, d).select("query")
    dense = cut(_dense(s, d).join(asks, "query", "left_semi"))
    fused = cut(R.fuse(lexical, dense))
    covered = R.rerank(fused, _docs(s, d), terms)
    lists = {"bm25": lexical, "dense": dense, "hybrid": R.ranked(fused, 10), "rerank": R.ranked(covered, 10, F.desc("coverage"))}
    told = None
    for mode, hits in lists.items():
        top = cut(hits.where("rank <= 10").select("query", "doc", "rank"))
        part = evaluate.rank_metrics(top, _relevant(top, _good(s, d)), asks).withColumn("mode", F.lit(mode))
        told = part if told is None else told.unionByName(part)
    return evaluate.baselines(told)


def _metrics_sql(top: str, by: str) -> str:
    """Metrics of the rows (by, query, doc, rank) of ``top``, for every query that asks."""
    return f"""j AS (SELECT {by}, rank, CASE WHEN doc IN (SELECT doc_id FROM labels WHERE quality = 1) THEN 1 ELSE 0 END AS good FROM {top} WHERE rank <= 10),
m AS (SELECT {by}, coalesce(max(CASE WHEN rank <= 1 THEN good ELSE 0 END), 0) AS hit1, coalesce(max(CASE WHEN rank <= 3 THEN good ELSE 0 END), 0) AS hit3, coalesce(max(CASE WHEN rank <= 5 THEN good ELSE 0 END), 0) AS hit5, coalesce(max(good), 0) AS hit10,
  round(coalesce(1.0::DOUBLE / min(CASE WHEN good = 1 THEN rank END), 0), 6) AS rr, round(coalesce(sum(CASE WHEN rank <= 5 THEN good ELSE 0 END), 0) / least(5, greatest(count(rank), 1)), 6) AS p5 FROM {{asked}} LEFT JOIN j USING ({by}) GROUP BY {by})"""


_MEANS = "round(avg(hit1), 6) AS hit1, round(avg(hit3), 6) AS hit3, round(avg(hit5), 6) AS hit5, round(avg(hit10), 6) AS hit10, round(avg(rr), 6) AS rr, round(avg(p5), 6) AS p5 FROM m"
METRICS = BM25 + ", " + _metrics_sql("lex", "query").format(asked="(SELECT query FROM asks)")
_TERMS_OF = ", t AS (SELECT query, list(term) AS terms FROM q GROUP BY query)"


def quotes(s, d):
    """Findings' sentences as quotes, of every three one as it stands, one with each 15th and one with each 7th character altered."""
    found = X.findings(T.sentences(_docs(s, d)), OUTCOMES, CONDITIONS, CUES).select("doc", F.col("rank").alias("pos"), "quote")
    altered = F.when(F.col("pos") % 3 == 1, F.regexp_replace("quote", "(?s)(.{14}).", "$1#")).when(F.col("pos") % 3 == 2, F.regexp_replace("quote", "(?s)(.{6}).", "$1#")).otherwise(F.col("quote"))
    return found.withColumn("quote", altered)


def _tag_sql() -> str:
    # the alternation is consumed with its neighbours in RE2, so texts are cut into words first
    cases = " UNION ALL ".join(f"SELECT doc, '{k}' AS term, CAST(len(list_filter(ws, lambda w: w IN ({', '.join(repr(p) for p in v.split('|'))}))) AS INT) AS n FROM w" for k, v in TERMS.items())
    return f"WITH w AS (SELECT doc_id AS doc, regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}_-]+') AS ws FROM documents) SELECT * FROM ({cases}) WHERE n > 0"


QUERIES = {
    "bm25_topk": (lambda s, d: _lexical(s, d), BM25 + " SELECT query, doc, score, rank FROM lex"),
    "dense_topk": (lambda s, d: _dense(s, d), "WITH " + DENSE + " SELECT query, doc, score, rank FROM den"),
    "rrf_hybrid": (lambda s, d: R.fuse(_lexical(s, d), _dense(s, d)), FUSED + " SELECT * FROM fused"),
    "hybrid_capped": (
        _capped,
        FUSED + """, c AS (SELECT query, doc, source AS report, score FROM fused JOIN documents ON doc_id = doc QUALIFY row_number() OVER (PARTITION BY query, source ORDER BY score DESC, doc) <= 2)
        SELECT query, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank, doc, report, score FROM c QUALIFY rank <= 10""",
    ),
    "rerank_coverage": (
        lambda s, d: R.rerank(_lexical(s, d).select("query", "doc", "score"), _docs(s, d), _terms(s, d)),
        BM25 + _TERMS_OF + ", c AS (SELECT query, doc, score, len(list_filter(terms, lambda t: contains(lower(text), substr(t, 1, 6)))) / len(terms) AS c FROM lex JOIN t USING (query) JOIN documents ON doc_id = doc) SELECT query, doc, round(c, 6) AS coverage, round(score + 0.01::DOUBLE * c, 9) AS score FROM c",
    ),
    "facet_page": (
        lambda s, d: R.facets(_docs(s, d).select("doc_id", "lang", "source", "n_chars"), F.col("lang").isin("fr", "es") & (F.col("n_chars") > 500), [F.desc("n_chars"), F.col("doc_id")], 10, 25),
        "WITH h AS (SELECT doc_id, lang, source, n_chars FROM documents WHERE lang IN ('fr', 'es') AND n_chars > 500) SELECT *, (SELECT count(*) FROM h) AS total FROM h ORDER BY n_chars DESC, doc_id LIMIT 25 OFFSET 10",
    ),
    "listed_documents": (
        lambda s, d: R.listing(_docs(s, d).select("doc_id", "lang", "source", F.concat_ws(" ", "source", "lang").alias("title")), _dense(s, d).where("query <= 3").select(F.col("doc").alias("doc_id")).distinct(), "doc_id", "title", "7", F.col("lang").isin("en", "fr"), [F.col("source"), F.col("doc_id")], 2, 60),
        "WITH " + DENSE + ", h AS (SELECT doc_id, lang, source, source || ' ' || lang AS title FROM documents WHERE lang IN ('en', 'fr') AND (doc_id IN (SELECT doc FROM den WHERE query <= 3) OR contains(source || ' ' || lang, '7') OR doc_id = 7)) SELECT *, (SELECT count(*) FROM h) AS total FROM h ORDER BY source, doc_id LIMIT 60 OFFSET 2",
    ),
    "related_items": (
        lambda s, d: R.related(read(s, d, "lineitem").select(F.col("l_orderkey").alias("paper"), F.col("l_partkey").alias("concept")).distinct()),
        "WITH t AS (SELECT DISTINCT l_orderkey AS paper, l_partkey AS concept FROM lineitem), s AS (SELECT l.paper, r.paper AS other, count(*) AS shared FROM t l JOIN t r USING (concept) WHERE l.paper <> r.paper GROUP BY ALL HAVING count(*) >= 2) SELECT paper, other, shared, row_number() OVER (PARTITION BY paper ORDER BY shared DESC, other) AS rank FROM s QUALIFY rank <= 6",
    ),
    "autocomplete": (
        lambda s, d: R.autocomplete(read(s, d, "part").groupBy(F.col("p_name").alias("name")).agg(F.count("*").alias("papers")), "s"),
        "SELECT p_name AS name, count(*) AS papers FROM part GROUP BY p_name HAVING contains(' ' || lower(p_name), ' s') ORDER BY papers DESC, name LIMIT 8",
    ),
    "clean_text": (
        lambda s, d: read(s, d, "pages").select("page_id", F.md5(T.clean(F.col("html")).cast("binary")).alias("digest")),
        # of all references of HTML these stand in the pages; an ampersand's comes last, as what it gives is not read again
        # of all references of HTML these stand in the pages; an ampersand's comes last, as what it gives is not read again
        "SELECT page_id, md5(trim(regexp_replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(html, '&amp;', chr(1)), '&amp', chr(1)), '&copy;', '©'), '&middot;', '·'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&nbsp;', ' '), chr(1), '&'), '\\s+', ' ', 'g'))) AS digest FROM pages",
    ),
    "strip_citations": (
        lambda s, d: _docs(s, d).select("doc_id", F.md5(T.strip_citations(F.concat(F.lit("Flames [1, 2] grow (Smith et al., 1999; Jones 2001a) here (Fig. 3) ."), "text")).cast("binary")).alias("digest")),
        r"SELECT doc_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace('Flames [1, 2] grow (Smith et al., 1999; Jones 2001a) here (Fig. 3) .' || text, '\[\d+(?:\s*[,–-]\s*\d+)*\]', '', 'g'), '\((?:[A-Z][A-Za-z''-]+(?: et al\.)?,? \d{4}[a-z]?(?:; )?)+\)', '', 'g'), '\((?:Fig|Figure|Table)s?\.? ?\d+[A-Za-z]?\)', '', 'g'), '\s+([.,;:])', '\1', 'g'), '\s+', ' ', 'g'))) AS digest FROM documents".replace("\\\\", "\\"),
    ),
    "paragraphs": (
        lambda s, d: T.paragraphs(_docs(s, d)).select("doc", "pos", F.length("block").alias("n")),
        "WITH b AS (SELECT doc_id AS doc, unnest(string_split(regexp_replace(text, '(\\w)-\\n(\\w)', '\\1\\2', 'g'), chr(10))) AS block, generate_subscripts(string_split(regexp_replace(text, '(\\w)-\\n(\\w)', '\\1\\2', 'g'), chr(10)), 1) - 1 AS pos FROM documents) SELECT doc, CAST(pos AS INT) AS pos, length(trim(block)) AS n FROM b WHERE trim(block) <> ''",
    ),
    "sections_fill": (
        lambda s, d: T.sections(T.paragraphs(_docs(s, d)), F.when(F.length("block") < 70, T.upper_case(F.substring("block", 1, 2)))).select("doc", "pos", "kind", "words"),
        """WITH b AS (SELECT doc_id AS doc, unnest(string_split(regexp_replace(text, '(\\w)-\\n(\\w)', '\\1\\2', 'g'), chr(10))) AS block, generate_subscripts(string_split(regexp_replace(text, '(\\w)-\\n(\\w)', '\\1\\2', 'g'), chr(10)), 1) - 1 AS pos FROM documents),
        m AS (SELECT doc, pos, trim(block) AS block, CASE WHEN length(trim(block)) < 70 THEN upper(substr(trim(block), 1, 2)) END AS head FROM b WHERE trim(block) <> ''),
        k AS (SELECT *, CASE WHEN head IS NULL THEN len(string_split(block, ' ')) ELSE 0 END AS words FROM m),
        t AS (SELECT *, coalesce(last_value(head IGNORE NULLS) OVER (PARTITION BY doc ORDER BY pos ROWS UNBOUNDED PRECEDING), 'BODY') AS kind, coalesce(sum(words) OVER (PARTITION BY doc ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS so_far FROM k)
        SELECT doc, CAST(pos AS INT) AS pos, kind, CAST(words AS INT) AS words FROM t WHERE so_far < 15000 AND head IS NULL""",
    ),
    "sentences": (
        lambda s, d: T.sentences(_docs(s, d)).groupBy("doc").agg(F.count("*").alias("n"), F.max(F.length("sentence")).alias("longest")),
        f"WITH x AS ({_SENT} FROM documents) SELECT doc, count(*) AS n, max(length(trim(sentence))) AS longest FROM x WHERE trim(sentence) <> '' GROUP BY doc",
    ),
    "chunks": (lambda s, d: T.document_chunks(_docs(s, d)), None),
    "dictionary_tags": (lambda s, d: X.tag_counts(_docs(s, d), TERMS), _tag_sql()),
    "chunk_tags": (
        lambda s, d: _docs(s, d).select("doc_id", F.array_join(X.tags(F.col("text"), TERMS, 12), ",").alias("tags")),
        "WITH w AS (SELECT doc_id, regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}_-]+') AS ws FROM documents) SELECT doc_id, array_to_string(list_filter([" + ", ".join(f"CASE WHEN len(list_filter(ws, lambda w: w IN ({', '.join(repr(x) for x in p.split('|'))}))) > 0 THEN '{k}' END" for k, p in TERMS.items()) + "], lambda x: x IS NOT NULL), ',') AS tags FROM w",
    ),
    "tagged_chunks": (lambda s, d: T.document_chunks(_docs(s, d)).select("doc", "n", "kind", F.array_join(X.tags(F.col("text"), TERMS, 12), ",").alias("tags")), None),
    "findings_extract": (lambda s, d: X.findings(T.sentences(_docs(s, d)), OUTCOMES, CONDITIONS, CUES), None),
    "extractive_summary": (
        lambda s, d: X.summary(T.sentences(_docs(s, d))),
        f"WITH {_SENT_POS} SELECT doc, sentence AS conclusion FROM st QUALIFY row_number() OVER (PARTITION BY doc ORDER BY regexp_matches(lower(sentence), 'conclu|show|found|demonstrat') DESC, pos DESC) = 1",
    ),
    "quote_guard": (lambda s, d: X.quote_guard(quotes(s, d), _docs(s, d).select(F.col("doc_id").alias("doc"), "text")).groupBy("doc").agg(F.count("*").alias("n"), F.count_if("ok").alias("ok")), None),
    "near_duplicate_reports": (lambda s, d: dedupe.mark(_reports(s, d)), None),
    "same_identifier": (
        lambda s, d: dedupe.same_identifier(read(s, d, "part").select(F.col("p_partkey").alias("id"), F.when(F.col("p_size") % 5 == 0, F.concat("p_brand", "p_type")).alias("doi"))),
        "WITH r AS (SELECT p_partkey AS id, CASE WHEN p_size % 5 = 0 THEN p_brand || p_type END AS doi FROM part), f AS (SELECT doi, min(id) AS other FROM r WHERE doi IS NOT NULL GROUP BY doi) SELECT id, other FROM r JOIN f USING (doi) WHERE id <> other",
    ),
    "followup_context": (
        lambda s, d: qa.follow_ups(read(s, d, "conversations")).select("conv_id", "turn", F.md5(F.col("question").cast("binary")).alias("digest"), "rewritten"),
        rf"""WITH u AS (SELECT *, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS before, list_filter(regexp_extract_all(lower(text), '[a-z0-9][a-z0-9\-]+'), lambda w: w NOT IN ({', '.join(repr(w) for w in STOP.split())}) AND length(w) > 2) AS w FROM conversations WHERE role = 'user'),
        n AS (SELECT *, before IS NOT NULL AND (regexp_matches(text, '{qa.FOLLOW_UP}') OR (len(w) <= 2 AND NOT regexp_matches(text, '{qa.QUESTION}'))) AS needs FROM u)
        SELECT conv_id, turn, md5(CASE WHEN needs THEN before || ' ' || text ELSE text END) AS digest, coalesce(needs, false) AS rewritten FROM n""",
    ),
    "interleaved": (
        lambda s, d: qa.interleaved(_lexical(s, d).where("rank <= 12"), _dense(s, d).where("rank <= 12")),
        FUSED + """, b AS (SELECT query, doc, rank, 0 AS side FROM lex WHERE rank <= 12 UNION ALL SELECT query, doc, rank, 1 FROM den WHERE rank <= 12), n AS (SELECT query, least(max(rank) FILTER (side = 0), max(rank) FILTER (side = 1)) AS n FROM b GROUP BY query HAVING count(DISTINCT side) = 2),
        f AS (SELECT query, doc, rank, side FROM b JOIN n USING (query) WHERE rank <= n QUALIFY row_number() OVER (PARTITION BY query, doc ORDER BY rank, side) = 1)
        SELECT query, row_number() OVER (PARTITION BY query ORDER BY rank, side) AS place, doc, side FROM f QUALIFY place <= 12""",
    ),
    "refusal_gate": (
        _gate,
        BM25 + _TERMS_OF + """, c AS (SELECT query, max(round(len(list_filter(terms, lambda t: contains(lower(text), substr(t, 1, 6)))) / len(terms), 2)) AS best FROM lex JOIN t USING (query) JOIN documents ON doc_id = doc WHERE rank <= 5 GROUP BY query),
        n AS (SELECT query, regexp_matches(' ' || lower(text) || ' ', '[^\\p{L}\\p{N}_-](than|les|que)[^\\p{L}\\p{N}_-]') AS domain FROM asks) SELECT query, best, best IS NULL OR best < 0.34 OR (NOT domain AND best < 0.8) AS refuse FROM n LEFT JOIN c USING (query)""",
    ),
    "sentence_scores": (
        lambda s, d: qa.sentence_scores(T.sentences(_docs(s, d)), F.array(F.lit("threat"), F.lit("clown"))),
        f"""WITH {_SENT_POS}, c AS (SELECT *, (contains(lower(sentence), 'threat')::INT + contains(lower(sentence), 'clown')::INT) / 2.0::DOUBLE AS cov FROM st WHERE {_FIT}),
        s AS (SELECT doc, pos, round(6 * cov + 0.4::DOUBLE * regexp_matches(lower(sentence), 'result|show|found')::INT - 0.03::DOUBLE * len(string_split(sentence, ' ')), 6) AS score FROM c WHERE cov > 0 QUALIFY row_number() OVER (PARTITION BY doc ORDER BY score DESC, pos) <= 2)
        SELECT doc, pos, score FROM s ORDER BY score DESC, doc, pos LIMIT 6""",
    ),
    "passage_support": (
        lambda s, d: read(s, d, "conversations").withColumn("before", F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))).select("conv_id", "turn", F.round(qa.support(F.col("text"), F.col("before")), 6).alias("support")),
        """WITH b AS (SELECT conv_id, turn, lower(lag(text) OVER (PARTITION BY conv_id ORDER BY turn)) AS t, list_distinct(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda w: length(w) >= 4)) AS ws FROM conversations)
        SELECT conv_id, turn, CASE WHEN t IS NOT NULL AND len(ws) > 0 THEN round(len(list_filter(ws, lambda w: contains(t, substr(w, 1, 6)))) / len(ws), 6) END AS support FROM b""",
    ),
    "knn_votes": (
        lambda s, d: predict.knn_votes(_vectors(s, d).select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), "label"), _vectors(s, d).where(F.col("vec_id") % 100 == 0).select(F.col("vec_id").alias("query"), F.col("embedding").alias("qv"))),
        """WITH n AS (SELECT q.vec_id AS query, e.vec_id AS id, e.label, sqrt(list_sum(list_transform(list_zip(e.embedding, q.embedding), lambda x: (x[1]::DOUBLE - x[2]::DOUBLE) * (x[1]::DOUBLE - x[2]::DOUBLE)))) AS d FROM embeddings e CROSS JOIN embeddings q WHERE q.vec_id % 100 = 0 AND e.vec_id <> q.vec_id),
        k AS (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY query ORDER BY d, id) <= 25), w AS (SELECT query, label, sum(1 / (d + 0.001::DOUBLE)) AS w FROM k GROUP BY ALL) SELECT query, label, round(w / sum(w) OVER (PARTITION BY query), 6) AS share FROM w""",
    ),
    "rank_metrics": (_metrics, METRICS + " SELECT query, hit1, hit3, hit5, hit10, rr, p5 FROM m"),
    "mode_baselines": (
        lambda s, d: evaluate.baselines(_metrics(s, d).withColumn("mode", F.lit("bm25"))),
        METRICS + " SELECT 'bm25' AS mode, " + _MEANS,
    ),
    "stage_baselines": (
        _stages,
        FUSED + _TERMS_OF + """, cov AS (SELECT query, doc, score, len(list_filter(terms, lambda t: contains(lower(text), substr(t, 1, 6)))) / len(terms) AS c FROM fused JOIN t USING (query) JOIN documents ON doc_id = doc), rr AS (SELECT query, doc, round(c, 6) AS coverage, round(score + 0.01::DOUBLE * c, 9) AS score FROM cov),
        l AS (SELECT 'bm25' AS mode, query, doc, rank FROM lex UNION ALL SELECT 'dense', query, doc, rank FROM den UNION ALL SELECT 'hybrid', query, doc, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) FROM fused
          UNION ALL SELECT 'rerank', query, doc, row_number() OVER (PARTITION BY query ORDER BY score DESC, coverage DESC, doc) FROM rr), asked AS (SELECT mode, query FROM asks CROSS JOIN (VALUES ('bm25'), ('dense'), ('hybrid'), ('rerank')) AS x(mode)), """
        + _metrics_sql("l", "mode, query").format(asked="asked") + " SELECT mode, " + _MEANS + " GROUP BY mode",
    ),
    "stratified_sample": (
        lambda s, d: evaluate.stratified(_docs(s, d).select("doc_id", "source"), "source", "doc_id", 50),
        "SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5('7:' || doc_id), doc_id) AS turn FROM documents ORDER BY turn, source LIMIT 50",
    ),
    "field_precision": (
        lambda s, d: evaluate.field_precision(read(s, d, "labels"), ["quality", "toxic"]),
        "SELECT f AS field, count(*) FILTER (v = 1) AS yes, count(*) FILTER (v = 0) AS no, round(count(*) FILTER (v = 1) / count(*) FILTER (v IN (0, 1)), 6) AS precision FROM (SELECT 'quality' AS f, quality AS v FROM labels UNION ALL SELECT 'toxic', toxic FROM labels) GROUP BY f",
    ),
    "source_audit": (
        lambda s, d: records.audit(read(s, d, "orders").select(F.year("o_orderdate").alias("y"), F.col("o_orderpriority").alias("k")), "y", "k"),
        "WITH o AS (SELECT CAST(year(o_orderdate) AS VARCHAR) AS y, o_orderpriority AS k FROM orders) SELECT measure, key, count(*) AS n FROM (SELECT 'total' AS measure, 'all' AS key FROM o UNION ALL SELECT CASE WHEN y IS NULL THEN 'no_year' ELSE 'year' END, coalesce(y, 'none') FROM o UNION ALL SELECT 'decade', substr(y, 1, 3) || '0s' FROM o UNION ALL SELECT 'kind', k FROM o) WHERE key IS NOT NULL GROUP BY ALL",
    ),
    "csv_flatten": (
        lambda s, d: export.flattened(_vectors(s, d).select("vec_id", F.slice(F.transform("embedding", lambda x: (x > 0).cast("int")), 1, 8).alias("signs"), "label"), ["vec_id", "signs", "label", "missing"]),
        "SELECT CAST(vec_id AS VARCHAR) AS vec_id, array_to_string(list_transform(embedding[1:8], lambda x: CASE WHEN x > 0 THEN 1 ELSE 0 END), '; ') AS signs, CAST(label AS VARCHAR) AS label FROM embeddings",
    ),
    "cite_bibtex": (
        lambda s, d: export.bibtex(_reports(s, d)),
        "WITH r AS (SELECT p_partkey AS id, p_brand || ', X.' AS author, p_name || ' ' || p_type || ' ' || p_size AS title, p_size + 1950 AS year FROM part) SELECT id, '@techreport{' || lower(regexp_replace(split_part(author, ',', 1), '[^A-Za-z]', '', 'g')) || year || lower(regexp_extract(title, '\\b([A-Za-z]{4,})\\b', 1)) || ',' || chr(10) || '  author = {' || regexp_replace(author, '([&%$#_{}])', '\\\\\\1', 'g') || '},' || chr(10) || '  title = {' || regexp_replace(title, '([&%$#_{}])', '\\\\\\1', 'g') || '},' || chr(10) || '  year = {' || year || '}' || chr(10) || '}' AS entry FROM r",
    ),
    "cite_ris": (
        lambda s, d: export.ris(_reports(s, d)),
        "SELECT p_partkey AS id, 'TY  - RPRT' || chr(10) || 'AU  - ' || p_brand || ', X.' || chr(10) || 'TI  - ' || p_name || ' ' || p_type || ' ' || p_size || chr(10) || 'PY  - ' || (p_size + 1950) || chr(10) || 'ER  - ' AS entry FROM part",
    ),
    "log_rollup": (
        lambda s, d: logs.hourly(read(s, d, "events")),
        "SELECT date_trunc('hour', ts) AS hour, event_type AS kind, count(*) AS n, round(CAST(sum(CAST(value AS DECIMAL(18,6))) AS DOUBLE), 4) AS total FROM events GROUP BY ALL",
    ),
    "duration_labels": (
        lambda s, d: read(s, d, "lineitem").select((F.col("l_quantity") * F.col("l_linenumber") * 900).alias("sec")).groupBy(formatting.duration(F.col("sec")).alias("label")).agg(F.count("*").alias("n")),
        "WITH l AS (SELECT l_quantity * l_linenumber * 900 AS sec FROM lineitem), t AS (SELECT CASE WHEN sec < 120 THEN CAST(round(sec) AS BIGINT) || ' s' WHEN sec < 7200 THEN CAST(round(sec / 60) AS BIGINT) || ' min' WHEN sec < 172800 THEN CAST(round(sec / 3600) AS BIGINT) || ' h' ELSE CAST(round(sec / 86400) AS BIGINT) || ' days' END AS label FROM l) SELECT label, count(*) AS n FROM t GROUP BY label",
    ),
}
