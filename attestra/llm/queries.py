"""The queries of this package: one per operator, each over its whole table, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, collocations, editprint, hosts, mih, packing, pagetext, quality, sharding, simhash, spans, subspaces, variants

WORD_TOKENIZER = "word_bpe_49k.json"
BYTE_TOKENIZER = "byte_bpe_50k.json"
URL_RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(build: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[build.__name__] = build
    return build


def vocabulary(name: str) -> str:
    """The place of a public tokenizer's file."""
    import public_tokenizers
    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


@query
def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in eight shards of near-equal bytes."""
    return sharding.shard_records(table(spark, sf_dir, "documents", "doc_id", "text"))


# Steps of the propagation in SQL, which has no loop until convergence; the test pages hold no links between hosts.
SQL_STEPS = 20


def url_filter_sql() -> str:
    """The rules as one CASE, and the propagation as one table per step."""
    def fits(rule: str) -> str:
        suffix, slash, prefix = rule.partition("/")
        return f"(host = '{suffix}' OR ends_with(host, '.{suffix}')) AND starts_with(path, '{slash + prefix}')"

    ranked = sorted(URL_RULES, key=lambda r: (len(r[1]), r[0] == "block"), reverse=True)
    case = lambda k: "CASE " + " ".join(f"WHEN {fits(rule)} THEN '{(action, rule)[k]}'" for action, rule in ranked) + " END"
    host = lambda rest: f"translate(regexp_extract({rest}, '^[^/?#]*'), '{hosts.UPPER}', '{hosts.LOWER}')"
    link = hosts.LINK.replace("'", "''")
    steps = [f"""s{k} AS MATERIALIZED (
        SELECT coalesce(b.host, m.host) AS host, coalesce(b.good, m.good) AS good, coalesce(seed, 0) AS seed,
               {1 - hosts.DAMPING} * coalesce(seed, 0) + {hosts.DAMPING} * coalesce(come, 0) AS score
        FROM s{k - 1} b FULL JOIN (SELECT w.dest AS host, s.good, sum(s.score * w.share) AS come
                                   FROM s{k - 1} s JOIN ways w ON w.host = s.host AND w.good = s.good GROUP BY 1, 2) m
        ON b.host = m.host AND b.good = m.good)""" for k in range(1, SQL_STEPS + 1)]
    return f"""WITH cut AS (
        SELECT page_id, html, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) END AS rest FROM pages),
    p AS (SELECT page_id, html, coalesce({host('rest')}, '') AS host, coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM cut),
    judged AS MATERIALIZED (SELECT *, {case(1)} AS rule, {case(0)} AS action FROM p),
    marks AS (SELECT host, count(*) FILTER (action = 'allow') AS trust, count(*) FILTER (action = 'block') AS distrust
              FROM judged WHERE action IS NOT NULL AND host <> '' GROUP BY 1),
    seeds AS (SELECT host, trust / greatest(1, sum(trust) OVER ()) AS trust, distrust / greatest(1, sum(distrust) OVER ()) AS distrust FROM marks),
    found AS (SELECT host AS source, unnest(list_distinct(list_transform(regexp_extract_all(html, '{link}', 1),
                     lambda x: {host("substr(x, position('//' IN x) + 2)")}))) AS target FROM p),
    pairs AS (SELECT source, target, count(*) AS n FROM found WHERE source <> '' AND target <> '' AND source <> target GROUP BY 1, 2),
    edges AS MATERIALIZED (SELECT source, target, n / sum(n) OVER (PARTITION BY source) AS share FROM pairs),
    ways AS MATERIALIZED (SELECT true AS good, source AS host, target AS dest, share FROM edges
             UNION ALL SELECT false, target, source, share / sum(share) OVER (PARTITION BY target) FROM edges),
    s0 AS MATERIALIZED (SELECT host, true AS good, trust AS seed, trust AS score FROM seeds UNION ALL SELECT host, false, distrust, distrust FROM seeds),
    {", ".join(steps)},
    ranks AS (SELECT host, coalesce(max(score) FILTER (good), 0) AS trust, coalesce(max(score) FILTER (NOT good), 0) AS distrust FROM s{SQL_STEPS} GROUP BY 1)
    SELECT page_id, j.host, path, rule, coalesce(action, CASE WHEN distrust > 0 AND distrust >= {hosts.DISTRUST_SHARE} * (trust + distrust) THEN 'block' END, 'allow') AS verdict
    FROM judged j LEFT JOIN ranks ON ranks.host = j.host"""


@query
def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on all page urls by rules and, without one, by trust and distrust of the host."""
    return hosts.judge(table(spark, sf_dir, "pages", "page_id", "url", "html"), URL_RULES)


@query
def op3_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of all pages."""
    return pagetext.extract(table(spark, sf_dir, "pages", "page_id", "url", "html"))


@query
def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of all documents and the texts decoded from them, as digests."""
    return bpe.encode_and_decode(table(spark, sf_dir, "documents", "doc_id", "text"), vocabulary(BYTE_TOKENIZER), digest=True)


@query
def op5_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the sentences that a repeated run covers, and the ranges removed."""
    return spans.remove_repeated(table(spark, sf_dir, "documents", "doc_id", "text"), every_end=True)


@query
def op6_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest vectors of every fiftieth vector among all."""
    rows = table(spark, sf_dir, "embeddings", "vec_id", "embedding")
    return mih.search(rows, rows.where("vec_id % 50 = 0"))


@query
def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 2048 tokens."""
    return packing.pack_documents(table(spark, sf_dir, "documents", "doc_id", "text"), vocabulary(WORD_TOKENIZER))


@query
def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of all documents by trees fitted outside the held-out fold."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    forest = quality.train(docs, table(spark, sf_dir, "labels", "doc_id", "quality"))
    return (quality.scored(docs, forest).withColumn("held_out", quality.held_out(F.col("doc_id")))
            .select("doc_id", "held_out", "score", (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted")))


@query
def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash near-duplicate components of all documents."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"))


@query
def op10_edit_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edit fingerprints of all documents and of their edited texts."""
    return editprint.compare_with_edits(table(spark, sf_dir, "documents", "doc_id", "text"))


@query
def op11_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all vectors by cosine."""
    return subspaces.near_duplicates(table(spark, sf_dir, "embeddings", "vec_id", "embedding"))


@query
def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2000 phrases of every lang over all documents."""
    return collocations.collocations(table(spark, sf_dir, "documents", "lang", "text"))


@query
def op13_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spelling variants of the words of all documents."""
    return variants.variants(table(spark, sf_dir, "documents", "doc_id", "text"))


SQL["op2_url_filter"] = url_filter_sql()

SQL["op11_near_vectors"] = """WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
    good AS MATERIALIZED (SELECT * FROM v WHERE len(e) > 0 AND len(list_filter(e, lambda x: isfinite(x))) = len(e) AND len(list_filter(e, lambda x: x <> 0)) > 0),
    pairs AS MATERIALIZED (SELECT a.vec_id AS x, b.vec_id AS y FROM good a JOIN good b ON a.vec_id < b.vec_id AND len(a.e) = len(b.e)
                           WHERE list_cosine_similarity(a.e, b.e) >= 0.95),
    edges AS MATERIALIZED (SELECT x, y FROM pairs UNION ALL SELECT y, x FROM pairs),
    reach AS (SELECT x, y FROM edges UNION SELECT r.x, e.y FROM reach r JOIN edges e ON e.x = r.y),
    named AS (SELECT v.vec_id, (SELECT count(*) FROM edges e WHERE e.x = v.vec_id) AS n_links, least(v.vec_id, (SELECT min(y) FROM reach r WHERE r.x = v.vec_id)) AS component_id FROM v)
    SELECT vec_id, n_links, component_id, vec_id = component_id AS kept FROM named"""

SQL["op12_collocations"] = f"""WITH p AS (SELECT coalesce(lang, 'und') AS lang,
           unnest(string_split_regex(translate(coalesce(text, ''), '{hosts.UPPER}', '{hosts.LOWER}'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
    w AS (SELECT lang, list_filter(string_split_regex(piece, '[\\x20\\x09]+'), lambda x: x <> '') AS ws FROM p),
    s AS (SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM w),
    g AS (SELECT lang, k, ws[i:i + k - 1] AS ws FROM s, (VALUES (1), (2), (3)) t(k) WHERE i + k - 1 <= len(ws)),
    f AS MATERIALIZED (SELECT lang, k, ws, count(*) AS f FROM g GROUP BY ALL),
    totals AS (SELECT lang, sum(f) AS n FROM f WHERE k = 1 GROUP BY lang),
    c AS (SELECT * FROM f WHERE k > 1 AND f >= 10),
    longer AS (SELECT lang, ws, max(f) AS f FROM (SELECT lang, ws[1:2] AS ws, f FROM c WHERE k = 3 UNION ALL SELECT lang, ws[2:3], f FROM c WHERE k = 3) GROUP BY ALL),
    kept AS (SELECT c.* FROM c LEFT JOIN longer l ON l.lang = c.lang AND l.ws = c.ws WHERE l.f IS NULL OR 100 * l.f < 50 * c.f),
    cuts AS (SELECT c.lang, c.ws, c.f AS a, j, l.f AS l, r.f AS r, (1000000::HUGEINT * c.f * c.f) // (l.f::HUGEINT * r.f) AS score
             FROM kept c, (VALUES (1), (2)) t(j), f l, f r
             WHERE j < c.k AND l.lang = c.lang AND l.ws = c.ws[1:j] AND r.lang = c.lang AND r.ws = c.ws[j + 1:c.k]),
    best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, ws ORDER BY score, j) = 1),
    named AS (SELECT *, array_to_string(ws, ' ') AS phrase FROM best),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM named)
    SELECT lang, rank, phrase, a, l, r, n::BIGINT AS n, score::BIGINT AS score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000"""

SQL["op13_variants"] = f"""WITH RECURSIVE crc AS MATERIALIZED (
        SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
    runs AS (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')), '{hosts.UPPER}', '{hosts.LOWER}') AS run FROM documents),
    counted AS (SELECT doc_id, run, count(*) AS n FROM runs WHERE length(run) >= 7 GROUP BY ALL),
    bytes AS (SELECT run, n, hex(encode(concat(doc_id, ':', run))) AS h FROM counted),
    marked AS (SELECT run, n, xor(list_reduce(list_prepend(4294967295, list_transform(range(len(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT)),
                                              lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS mark FROM bytes, crc),
    words AS MATERIALIZED (SELECT CASE WHEN mark % 31 = 0 THEN substr(run, 1, mark % length(run)) || substr(run, mark % length(run) + 2) ELSE run END AS word, sum(n)::BIGINT AS n
                           FROM marked GROUP BY 1 HAVING sum(n) >= 2 AND length(word) >= 7),
    places AS (SELECT word, n, unnest(range(length(word))) AS i FROM words),
    skips AS MATERIALIZED (SELECT word, n, substr(word, 1, i) AS head, substr(word, i + 2) AS tail FROM places),
    more AS MATERIALIZED (SELECT DISTINCT s.word AS x, w.word AS y FROM skips s JOIN words w ON w.word = s.head || s.tail),
    pairs AS (SELECT a.word AS x, b.word AS y FROM skips a JOIN skips b ON a.head = b.head AND a.tail = b.tail AND a.word <> b.word
              UNION ALL SELECT x, y FROM more UNION ALL SELECT y, x FROM more),
    near AS (SELECT x, y, n, count(*) OVER (PARTITION BY x) AS n_near FROM pairs JOIN words ON word = y
             QUALIFY row_number() OVER (PARTITION BY x ORDER BY n DESC, y) = 1),
    linked AS MATERIALIZED (SELECT word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN r.n >= 10 * w.n THEN y END AS form, CASE WHEN r.n >= 10 * w.n THEN r.n END AS form_n
                            FROM words w LEFT JOIN near r ON x = word),
    chain AS (SELECT word, word AS root, 0 AS step FROM linked UNION ALL SELECT c.word, l.form, step + 1 FROM chain c JOIN linked l ON l.word = c.root WHERE l.form IS NOT NULL),
    ends AS (SELECT word, arg_max(root, step) AS root FROM chain GROUP BY 1)
    SELECT word, form, root, n, n_near, form_n FROM linked JOIN ends USING (word)"""
