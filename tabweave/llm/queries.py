"""One query per operator over the given tables, and the SQL that some agree with."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabweave.llm.bpe import encode_texts
from tabweave.llm.fuzzy_lines import RUNS, dedup_lines
from tabweave.llm.gru_lm import score_documents
from tabweave.llm.html_diff import extract_pages
from tabweave.llm.merkle import prove_rows
from tabweave.llm.mixing import mix_sources, word_count
from tabweave.llm.quality_forest import judge_quality
from tabweave.llm.simhash_bk import near_duplicates
from tabweave.llm.token_scan import count_tokens
from tabweave.llm.topk_nra import top_k
from tabweave.llm.turn_repair import repair_conversations
from tabweave.llm.url_rules import PatternRule, SiteRule, filter_urls
from tabweave.llm.warc import round_trip

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return add


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


#: The vocabulary, and an id that it leaves free.
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
END_OF_DOCUMENT = 50256


@query()
def op1_html_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(read(spark, sf_dir, "pages"))


@query()
def op2_token_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(read(spark, sf_dir, "documents"), RANKS, public_tokenizers.PATTERN, END_OF_DOCUMENT)


@query()
def op3_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = dedup_lines(read(spark, sf_dir, "documents"), runs=RUNS)
    return left.select("doc_id", "n_removed", F.length("text").cast("bigint").alias("n_chars"), F.md5("text").alias("text_md5"))


@query()
def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_texts(read(spark, sf_dir, "documents"), RANKS, public_tokenizers.PATTERN)


# Fixed values of the query: sites, then patterns of pages that a crawl does not want.
SITES = (
    SiteRule("org", "/", "allow"),
    SiteRule("example.org", "/es/", "block"),
    SiteRule("example.org", "/en/1", "block"),
    SiteRule("com", "/fr/", "allow"),
    SiteRule("com", "/de/", "block"),
)
PATTERNS = (
    "^page=*&ref=",
    "?ref=x|",
    "||m.*.com^en^",
    "||blog.*^es/*/|",
    "^login^",
    "^wp-admin^",
    "/feed.xml|",
    "||ads.*^",
    "&sessionid=",
    "@@||www.*^en^",
    "@@^sitemap.xml|",
)


def _url_sql() -> str:
    rest = "substr(url, strpos(url, '://') + 3)"
    host = f"translate(regexp_extract({rest}, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    path = f"regexp_extract(substr({rest}, length(regexp_extract({rest}, '^[^/?#]*')) + 1), '^[^?#]*')"
    lowered = "translate(coalesce(url, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    sites = sorted(SITES, key=lambda s: -len(s.text))
    fits = {s: f"((host = '{s.host}' OR ends_with(host, '.{s.host}')) AND starts_with(path, '{s.path}'))" for s in sites}
    rule = "CASE " + " ".join(f"WHEN {fits[s]} THEN '{s.text}'" for s in sites) + " END"
    verdict = "CASE " + " ".join(f"WHEN {fits[s]} THEN '{s.verdict}'" for s in sites)
    patterns = sorted(map(PatternRule, PATTERNS), key=lambda p: not p.allows)
    hits = {p: "regexp_matches(lowered, '" + p.regex.replace("'", "''") + "', 's')" for p in patterns}
    by_pattern = " ".join(f"WHEN {hits[p]} THEN '{'allow' if p.allows else 'block'}'" for p in patterns)
    named = "CASE " + " ".join(f"WHEN {hits[p]} THEN '{p.text}'" for p in patterns) + " END"
    return f"""
        WITH cut AS (
            SELECT page_id, {lowered} AS lowered,
                   CASE WHEN strpos(url, '://') > 0 THEN {host} ELSE '' END AS host,
                   CASE WHEN strpos(url, '://') > 0 THEN {path} ELSE '' END AS path
            FROM pages)
        SELECT page_id, host, path, {rule} AS rule, {verdict} {by_pattern} ELSE 'allow' END AS verdict,
               {named} AS pattern
        FROM cut"""


@query(_url_sql())
def op5_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(read(spark, sf_dir, "pages"), PATTERNS, SITES)


@query()
def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"))


@query(
    """
    WITH sized AS (
        SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest
        FROM pages),
    kept AS (
        SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS response
        FROM sized)
    SELECT page_id, payload_bytes, payload_digest,
           CASE WHEN response = page_id THEN 'response' ELSE 'revisit' END AS record_type,
           CASE WHEN response <> page_id THEN response END AS refers_to
    FROM kept"""
)
def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = round_trip(read(spark, sf_dir, "pages"))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query()
def op8_quality_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_quality(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


@query(
    """
    WITH whole AS (
        SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
        FROM embeddings
        WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
          AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    scored AS (
        SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
               CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
        FROM whole q JOIN whole c ON q.vec_id <> c.vec_id
        WHERE q.vec_id % 50 = 0)
    SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
    FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
    WHERE rank <= 5"""
)
def op9_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


#: The most repeated source is seen twice for each time that the largest is seen once.
MAX_SPREAD = 2.0


@query()
def op10_temperature_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(read(spark, sf_dir, "documents"), word_count(), max_spread=MAX_SPREAD)


def _crc_sql(text: str) -> str:
    """CRC-32 of an ASCII text, bit by bit."""
    steps = f"flatten(list_transform(string_split({text}, ''), lambda ch: [CAST(ascii(ch) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))"
    fold = "lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, (a & 1) * 3988292384) END"
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {steps}), {fold}), 4294967295)"


#: What a leaf of the manifest hashes.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _manifest_sql() -> str:
    def leaf(text: str) -> str:
        values = [f"CAST({c} AS VARCHAR)" for c in FIELDS[:-1]] + [text]
        return "sha256(" + " || ".join(f"coalesce(octet_length(encode({v})) || ':' || {v}, '-')" for v in values) + ")"

    lowered = f"translate(text, '{UPPER}', '{LOWER}')"
    return f"""
        WITH RECURSIVE leaves AS (
            SELECT doc_id, lang, {leaf("text")} AS leaf,
                   CASE WHEN {_crc_sql("CAST(doc_id AS VARCHAR)")} % 3 = 0 THEN {leaf(lowered)} ELSE {leaf("text")} END AS found
            FROM documents),
        placed AS (
            SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM leaves),
        tree AS (
            SELECT lang, 0 AS level, pos, leaf AS node FROM placed
            UNION ALL
            SELECT lang, level + 1, pos // 8, sha256(string_agg(node, '' ORDER BY pos))
            FROM (SELECT *, count(*) OVER (PARTITION BY lang, level) AS n FROM tree)
            WHERE n > 1
            GROUP BY lang, level, pos // 8),
        subroots AS (
            SELECT lang, arg_max(node, level) AS subroot, max(level) AS levels, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos
            FROM tree GROUP BY lang),
        top AS (
            SELECT 0 AS level, pos, subroot AS node FROM subroots
            UNION ALL
            SELECT level + 1, pos // 8, sha256(string_agg(node, '' ORDER BY pos))
            FROM (SELECT *, count(*) OVER (PARTITION BY level) AS n FROM top)
            WHERE n > 1
            GROUP BY level, pos // 8),
        nodes AS (
            SELECT lang, FALSE AS up, level, pos, node FROM tree
            UNION ALL SELECT NULL, TRUE, level, pos, node FROM top),
        runs AS (
            SELECT lang, up, level, pos // 8 AS parent, list(node ORDER BY pos) AS run FROM nodes GROUP BY ALL),
        climb AS (
            SELECT p.doc_id, p.leaf, p.lang, p.pos AS row, FALSE AS up, 0 AS level, p.pos AS pos, p.found AS node, '' AS proof
            FROM placed p
            UNION ALL
            SELECT c.doc_id, c.leaf, c.lang, c.row, c.up OR c.level = s.levels, CASE WHEN NOT c.up AND c.level = s.levels THEN 0 ELSE c.level + 1 END,
                   CASE WHEN NOT c.up AND c.level = s.levels THEN s.pos ELSE c.pos // 8 END,
                   CASE WHEN NOT c.up AND c.level = s.levels THEN c.node
                        ELSE sha256(array_to_string(list_concat(r.run[:c.pos % 8], [c.node], r.run[c.pos % 8 + 2:]), '')) END,
                   CASE WHEN NOT c.up AND c.level = s.levels THEN c.proof
                        ELSE c.proof || array_to_string(list_concat(r.run[:c.pos % 8], r.run[c.pos % 8 + 2:]), '') END
            FROM climb c
            JOIN subroots s ON s.lang IS NOT DISTINCT FROM c.lang
            JOIN runs r ON r.up = c.up AND r.level = c.level AND r.parent = c.pos // 8 AND (c.up OR r.lang IS NOT DISTINCT FROM c.lang)
            WHERE NOT (c.up AND c.level = (SELECT max(level) FROM top)))
        SELECT c.doc_id, c.leaf, s.subroot, t.node AS root, sha256(c.proof) AS proof_sha256, c.node AS folded_root, c.node = t.node AS verified
        FROM climb c
        JOIN subroots s ON s.lang IS NOT DISTINCT FROM c.lang
        JOIN top t ON c.up AND c.level = t.level AND t.level = (SELECT max(level) FROM top)"""


@query(_manifest_sql())
def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    changed = F.when(drawn, F.translate("text", UPPER, LOWER)).otherwise(F.col("text"))
    return prove_rows(read(spark, sf_dir, "documents"), FIELDS, tampered=("text", changed))


def _moves_sql() -> str:
    """What may be done with a row in each state, inserts first: state, next, cost, edits, inserted lines, initial, edit."""
    after, names = {"0": "u", "s": "u", "u": "a", "a": "u"}, {"u": "user", "a": "assistant"}
    rows = []
    for start in "0sua":
        state, edits, lines = start, "", ""
        for _ in range(3):
            cost, new = 2 * len(edits), after[state]
            rows += [(start, state, cost + 3, edits + "D", lines, "", "D"), (start, new, cost + 2, edits + "R", lines, names[new], "R")]
            rows += [(start, c, cost, edits + "K", lines, c, "K") for c in ((new, "s") if state == "0" else new)]
            state, edits, lines = new, edits + "I", lines + "\n" + names[new] + ":"
    return ", ".join("(" + ", ".join(repr(v) for v in r) + ")" for r in rows).replace("\\n", "\n")


def _repair_sql() -> str:
    name = "coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')"
    return rf"""
        WITH RECURSIVE drawn AS (
            SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_crc_sql(name)} % 20 AS fate
            FROM conversations),
        damaged AS (
            SELECT conv_id, turn, CASE fate WHEN 4 THEN 'user' ELSE role END AS role,
                   CASE fate WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
            FROM (SELECT *, unnest(range(CASE fate WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM drawn)),
        numbered AS (
            SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i, left(role, 1) AS c
            FROM damaged),
        known AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again FROM numbered),
        faulty AS (
            SELECT *, lag(c) OVER (PARTITION BY conv_id ORDER BY i) AS before,
                   CASE WHEN NOT regexp_matches(text, '[^ 	-
]') THEN 'blank' WHEN again THEN 'duplicate'
                        WHEN NOT regexp_matches(text, '[.!?][ 	-
]*$') THEN 'truncated' ELSE 'none' END AS fault
            FROM known),
        moves(state, after, cost, edits, lines, wants, edit) AS (VALUES {_moves_sql()}),
        ways AS (
            SELECT DISTINCT conv_id, CAST(0 AS BIGINT) AS i, '0' AS state, CAST(0 AS BIGINT) AS cost, '' AS audit, '' AS body FROM conversations
            UNION ALL
            SELECT w.conv_id, r.i, m.after,
                   w.cost + m.cost + CASE WHEN m.edit <> 'D' AND r.fault = 'truncated' THEN 1 ELSE 0 END AS new_cost,
                   w.audit || m.edits AS new_audit,
                   w.body || m.lines || CASE m.edit WHEN 'K' THEN chr(10) || r.role || ':' || r.text WHEN 'R' THEN chr(10) || m.wants || ':' || r.text ELSE '' END
            FROM ways w
            JOIN faulty r ON r.conv_id IS NOT DISTINCT FROM w.conv_id AND r.i = w.i + 1
            JOIN moves m ON m.state = w.state AND (m.edit = 'D' OR r.fault NOT IN ('blank', 'duplicate')) AND (m.edit <> 'K' OR m.wants = r.c)
            QUALIFY row_number() OVER (PARTITION BY w.conv_id, r.i, m.after ORDER BY new_cost, new_audit) = 1),
        tails(state, cost, edits, lines) AS (
            VALUES ('0', 0, '', ''), ('s', 4, 'II', chr(10) || 'user:' || chr(10) || 'assistant:'), ('u', 2, 'I', chr(10) || 'assistant:'), ('a', 0, '', '')),
        counted AS (
            SELECT c.conv_id, count(r.i) AS n, coalesce(max(r.turn) - min(r.turn) + 1 - count(DISTINCT r.turn), 0) AS gaps,
                   count(*) FILTER (r.fault = 'blank') AS blank, count(*) FILTER (r.fault = 'duplicate') AS duplicate,
                   count(*) FILTER (r.fault = 'truncated') AS truncated,
                   count(*) FILTER (r.before || r.c NOT IN ('su', 'ua', 'au')) AS illegal
            FROM (SELECT DISTINCT conv_id FROM conversations) c
            LEFT JOIN faulty r ON r.conv_id IS NOT DISTINCT FROM c.conv_id
            GROUP BY c.conv_id),
        ended AS (
            SELECT n.*, w.cost + t.cost AS cost, w.audit || t.edits AS audit, sha256(substr(w.body || t.lines, 2)) AS repaired_sha256
            FROM counted n
            JOIN ways w ON w.conv_id IS NOT DISTINCT FROM n.conv_id AND w.i = n.n
            JOIN tails t ON t.state = w.state
            QUALIFY row_number() OVER (PARTITION BY n.conv_id ORDER BY w.cost + t.cost, w.audit || t.edits) = 1)
        SELECT conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 FROM ended"""


@query(_repair_sql())
def op12_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = read(spark, sf_dir, "conversations")
    conv, turn = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn"))
    fate = F.crc32(F.concat(conv, F.lit(":"), turn)) % 20
    text, role = (F.coalesce(F.col(c), F.lit(" ")) for c in ("text", "role"))
    damaged = given.select(
        "conv_id",
        "turn",
        F.when(fate == 4, "user").otherwise(role).alias("role"),
        F.when(fate == 1, "").when(fate == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        fate.alias("fate"),
    )
    return repair_conversations(damaged, live=F.col("fate") != 0, copies=F.when(F.col("fate") == 3, 2).otherwise(1))


@query()
def op13_gru_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(read(spark, sf_dir, "documents"), F.crc32(F.col("doc_id").cast("string")) % 5 == 1)
