"""Text detectors over documents: repeated lines and windows, runs, secrets, personal data, checklists."""

from __future__ import annotations

from pyspark.sql import functions as F

from assayer.functions import shapes
from assayer.functions import text as T
from assayer.operators import clones, lines
from assayer.operators.common import table
from assayer.plans.registry import query


def _lines(spark, sf_dir):
    return lines.lines(table(spark, sf_dir, "documents"))


_LINES = "l AS (SELECT doc_id, unnest(string_split(text, '\n')) line, generate_subscripts(string_split(text, '\n'), 1) line_no FROM documents)"


@query(
    "duplicate_predicates",
    f"WITH {_LINES}, n AS (SELECT doc_id, regexp_replace(line, '\\s+', '', 'g') norm FROM l) SELECT sha256(norm) norm_sha256, count(DISTINCT doc_id) places, min(doc_id) AS first FROM n WHERE length(norm) >= 30 GROUP BY norm HAVING count(DISTINCT doc_id) >= 2",
)
def _(spark, sf_dir):
    norm = _lines(spark, sf_dir).select("doc_id", F.regexp_replace("line", r"\s+", "").alias("norm")).where(F.length("norm") >= 30)
    return clones.repeated_values(norm, "norm", "doc_id").select(F.sha2("norm", 256).alias("norm_sha256"), "places", "first")


def _tokens(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.filter(F.split("text", r"[ \n\t]+"), lambda w: w != "").alias("words"))


_TOKENS = "t AS (SELECT doc_id, [x for x in regexp_split_to_array(text, '[ \n\t]+') if x <> ''] w FROM documents)"
#: A window of 70 tokens repeats if another text holds it, or its own text does 70 tokens away.
_REP = f"""{_TOKENS}, p AS (SELECT doc_id, w, unnest(generate_series(1, len(w) - 69)) pos FROM t WHERE len(w) >= 70),
win AS (SELECT doc_id, pos, hash(array_to_string(w[pos:pos + 69], ' ')) h, array_to_string(w[pos:pos + 2], ' ') g FROM p),
d AS (SELECT h, g, doc_id, min(pos) a, max(pos) b, count(*) n FROM win GROUP BY ALL), f AS (SELECT h, g, count(*) texts, sum(n) places FROM d GROUP BY ALL),
rep AS (SELECT doc_id, pos, places::BIGINT places FROM win JOIN f USING (h, g) JOIN d USING (h, g, doc_id) WHERE texts > 1 OR pos - a >= 70 OR b - pos >= 70),
gaps AS (SELECT *, CASE WHEN pos <= lag(pos) OVER (PARTITION BY doc_id ORDER BY pos) + 70 THEN 0 ELSE 1 END fresh FROM rep),
runs AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY pos) run FROM gaps),
regions AS (SELECT doc_id, min(pos) AS start, max(pos) + 69 AS "end", max(places) places FROM runs GROUP BY doc_id, run)"""


@query("clone_windows", f"WITH {_REP} SELECT doc_id, pos::INT pos, places FROM rep")
def _(spark, sf_dir):
    return clones.repeated_windows(_tokens(spark, sf_dir))


@query("clone_regions", f'WITH {_REP} SELECT doc_id, start::INT AS start, "end"::INT AS "end", ("end" - start + 1)::INT tokens, places FROM regions')
def _(spark, sf_dir):
    return clones.regions(clones.repeated_windows(_tokens(spark, sf_dir)))


_COVERED = 'c AS (SELECT doc_id, sum("end" - start + 1) n FROM regions GROUP BY 1)'


@query("clone_share", f"WITH {_REP}, {_COVERED} SELECT t.doc_id, len(w) n_tokens, coalesce(n, 0)::BIGINT n_repeated FROM t LEFT JOIN c USING (doc_id)")
def _(spark, sf_dir):
    tokens = _tokens(spark, sf_dir)
    return clones.covered_share(clones.regions(clones.repeated_windows(tokens)), tokens)


@query(
    "clone_score",
    f"WITH {_REP}, {_COVERED}, s AS (SELECT lang, sum(len(w)) a, sum(coalesce(n, 0)) b FROM t LEFT JOIN c USING (doc_id) JOIN documents USING (doc_id) GROUP BY 1) SELECT lang, round(least(10, 10 * greatest(0, 1 - 5 * b / a)), 2) score FROM s",
)
def _(spark, sf_dir):
    tokens = _tokens(spark, sf_dir)
    shares = clones.covered_share(clones.regions(clones.repeated_windows(tokens)), tokens).join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    return shares.groupBy("lang").agg(shapes.score2(10 * F.greatest(F.lit(0.0), 1 - 5 * F.sum("n_repeated") / F.sum("n_tokens"))).alias("score"))


@query(
    "commented_runs",
    f"WITH {_LINES}, s AS (SELECT *, line_no - row_number() OVER (PARTITION BY doc_id ORDER BY line_no) g FROM l WHERE length(line) < 80) SELECT doc_id, min(line_no)::INT AS first, max(line_no)::INT AS last, count(*) n FROM s GROUP BY doc_id, g HAVING count(*) >= 2",
)
def _(spark, sf_dir):
    return lines.islands(_lines(spark, sf_dir), "doc_id", "line_no", F.length("line") < 80).where("n >= 2")


@query(
    "line_context_window",
    f"WITH {_LINES}, c AS (SELECT doc_id, line_no, line, max(CASE WHEN regexp_matches(line, 'icense') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN 6 PRECEDING AND 5 FOLLOWING) f FROM l) SELECT doc_id, line_no::INT line_no, sha256(line) line_sha256 FROM c WHERE f = 1",
)
def _(spark, sf_dir):
    rows = _lines(spark, sf_dir)
    near = lines.context(rows, "doc_id", "line_no", F.col("line").rlike("icense"), -6, 5)
    return rows.withColumn("near", near).where("near").select("doc_id", "line_no", F.sha2("line", 256).alias("line_sha256"))


@query(
    "interval_merge",
    f"WITH {_LINES}, o AS (SELECT doc_id, line_no s, line_no + length(line) // 40 e FROM l), b AS (SELECT *, max(e) OVER (PARTITION BY doc_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) m FROM o), g AS (SELECT *, sum(CASE WHEN m IS NULL OR s > m + 3 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) g FROM b) SELECT doc_id, min(s)::INT AS start, max(e)::INT AS end, count(*) n FROM g GROUP BY doc_id, g",
)
def _(spark, sf_dir):
    rows = _lines(spark, sf_dir).select("doc_id", F.col("line_no").alias("start"), (F.col("line_no") + F.floor(F.length("line") / 40)).cast("int").alias("end"))
    return lines.merge_intervals(rows, ["doc_id"], gap=3)


def _case(rules) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches(text, '{p}') THEN '{k}'" for k, p in rules) + " END"


#: The ladder of the rule, and after it marks that these documents have.
_LADDER = (*T.FLAKY, ("licence", "icense"), ("address", "@"), ("menu", "[|]"), ("symbols", "[#$%&*]{3}"))


@query("flaky_first_match", f"SELECT doc_id, {_case(_LADDER)} reason FROM documents WHERE {_case(_LADDER)} IS NOT NULL")
def _(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.first_match(F.col("text"), _LADDER).alias("reason")).where("reason is not null")


def _counts(patterns: dict[str, str]) -> str:
    quoted = {k: p.replace("'", "''") for k, p in patterns.items()}
    return " UNION ALL ".join(f"SELECT doc_id, '{k}' kind, len(regexp_extract_all(text, '{p}')) n FROM documents WHERE regexp_matches(text, '{p}')" for k, p in quoted.items())


@query("secrets_scan", _counts(T.SECRET_PATTERNS))
def _(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.explode(T.hits(F.col("text"), T.SECRET_PATTERNS)).alias("h")).select("doc_id", "h.kind", "h.n")


@query("pii_scan", _counts(T.PII_PATTERNS))
def _(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.explode(T.hits(F.col("text"), T.PII_PATTERNS)).alias("h")).select("doc_id", "h.kind", "h.n")


@query(
    "entropy",
    "WITH w AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(text, '[A-Za-z0-9]{20,}'))) word FROM documents), c AS (SELECT doc_id, word, unnest(string_split(word, '')) ch FROM w), n AS (SELECT doc_id, word, ch, count(*) n FROM c GROUP BY ALL) SELECT doc_id, word, round(-sum(n / length(word) * log2(n / length(word))), 6) bits FROM n GROUP BY doc_id, word",
)
def _(spark, sf_dir):
    words = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit("[A-Za-z0-9]{20,}"), 0))).alias("word"))
    return words.select("doc_id", "word", F.round(T.entropy(F.col("word")), 6).alias("bits"))


_README = {"long enough": "length(text) >= 500", "several lines": "contains(text, '\n')", "licence": "regexp_matches(text, '(?i)licen[cs]ed?')", "link": "regexp_matches(text, 'https?://')", "example": "regexp_matches(text, '[{}();=]')"}


@query(
    "readme_checklist",
    " UNION ALL ".join(f"SELECT doc_id, '{k}' item FROM documents WHERE NOT ({t})" for k, t in _README.items()),
)
def _(spark, sf_dir):
    text = F.col("text")
    tests = {"long enough": F.length(text) >= 500, "several lines": F.contains(text, F.lit("\n")), "licence": text.rlike("(?i)licen[cs]ed?"), "link": text.rlike("https?://"), "example": text.rlike("[{}();=]")}
    items = F.array(*(F.struct(F.lit(k).alias("item"), v.alias("ok")) for k, v in tests.items()))
    return table(spark, sf_dir, "documents").select("doc_id", F.explode(F.filter(items, lambda i: ~i["ok"])).alias("i")).select("doc_id", "i.item")


@query(
    "contamination_overlap",
    f"WITH {_TOKENS}, b AS (SELECT item_id, [x for x in regexp_split_to_array(text, '[ \n\t]+') if x <> ''] w FROM benchmark), dg AS (SELECT doc_id, array_to_string(w[p:p + 7], ' ') g FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 7)) p FROM t WHERE len(w) >= 8)), bg AS (SELECT item_id, array_to_string(w[p:p + 7], ' ') g FROM (SELECT item_id, w, unnest(generate_series(1, len(w) - 7)) p FROM b WHERE len(w) >= 8)) SELECT doc_id, item_id, count(DISTINCT bg.g) shared FROM dg JOIN bg ON dg.g = bg.g GROUP BY 1, 2",
)
def _(spark, sf_dir):
    docs = clones.windows(_tokens(spark, sf_dir), 8).select("doc_id", "h1", "h2")
    items = table(spark, sf_dir, "benchmark").select("item_id", F.filter(F.split("text", r"[ \n\t]+"), lambda w: w != "").alias("words"))
    grams = clones.windows(items, 8, key="item_id").select("item_id", "h1", "h2").distinct()
    return docs.join(grams, ["h1", "h2"]).distinct().groupBy("doc_id", "item_id").agg(F.count(F.lit(1)).alias("shared"))
