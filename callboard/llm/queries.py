"""One registered query per operator, over the whole of its table, and reference SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callboard import session
from callboard.llm import (
    alignment,
    bpe,
    covertree,
    decontam,
    langid,
    linededup,
    merkle,
    pii,
    secretscan,
    sharding,
    simhash,
    tagpath,
    warc,
    workspace,
)
from callboard.sources.tables import driver_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

SHARDS = tuple(f"shard-{i:03d}" for i in range(256))
#: Key of the pseudonyms in the registered query; a job of your own takes it from a secret store.
QUERY_KEY = "registered-query"


def query(name: str, sql: str | None = None):
    """Register ``fn(table)``, where ``table(name)`` scans one table of the folder."""

    def add(fn):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            session.tune(spark)
            return fn(lambda table: spark.read.parquet(driver_path(folder, table)))

        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return add


def vocabulary(name: str) -> str:
    """Where a public tokenizer's file lies; operators take such a path as a parameter."""
    return public_tokenizers.path(name)


def encoded(docs: DataFrame, *columns: str) -> DataFrame:
    """``columns``, ``n_tokens`` and ``ids`` of every document, by a lexicon of these documents' words."""
    name = bpe.publish(docs, "text", vocabulary("byte_bpe_50k.json"))
    coded = bpe.encode(docs, name, columns=columns, decoded="decoded")
    count = (F.octet_length("ids") / 4).cast("bigint")
    back = F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256")
    return coded.select(*columns, count.alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), "ids", back)


@query("op1_transducer_bpe")
def _op1(table):
    return encoded(table("documents").select("doc_id", "text"), "doc_id").drop("ids")


_BASE32 = " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (v >> {s}) % 32 + 1, 1)" for s in (15, 10, 5, 0))
_WARC_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
h AS (SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha1(html) AS hex, html FROM p),
first AS (SELECT html, max(page_id) AS page FROM h GROUP BY html),
part AS (
  SELECT page_id, i, CAST('0x' || substr(hex, i * 5 + 1, 5) AS INTEGER) AS v
  FROM (SELECT page_id, hex, unnest(range(0, 8)) AS i FROM h)),
d AS (SELECT page_id, string_agg({_BASE32}, '' ORDER BY i) AS payload_digest FROM part GROUP BY page_id)
SELECT h.page_id, payload_bytes, payload_digest, CASE WHEN page = h.page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page <> h.page_id THEN page END AS refers_to
FROM h JOIN first ON h.html = first.html JOIN d ON h.page_id = d.page_id"""


@query("op2_warc_round_trip", _WARC_SQL)
def _op2(table):
    """Every page written as a record and read back from the archives by the index."""
    pages = table("pages")
    index = warc.write(pages, workspace.folder(pages.sparkSession, "warc"))
    return warc.read(index, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op3_segmentation_language_id")
def _op3(table):
    return langid.identified(table("documents"), vocabulary("byte_bpe_multi_50k.tiktoken"))


def _placement_sql() -> str:
    """The filled table as one list of shard numbers, and the hash of a key."""
    number = {name: k for k, name in enumerate(SHARDS)}
    owners = ",".join(str(number[s]) for s in sharding.fill(SHARDS))
    return f"""
WITH d AS (SELECT doc_id, source, CAST(CAST('0x' || substr(md5(coalesce('=' || doc_id, '-')), 1, 15) AS BIGINT) % {sharding.SIZE} AS BIGINT) AS slot
  FROM documents),
t AS (SELECT unnest(range(0, {sharding.SIZE})) AS slot, unnest([{owners}]) AS n)
SELECT doc_id, source, d.slot, printf('shard-%03d', n) AS shard FROM d JOIN t ON d.slot = t.slot"""


@query("op4_permutation_table_sharding", _placement_sql())
def _op4(table):
    """The slot and shard of every document, by its id."""
    return sharding.place(table("documents").select("doc_id", "source"), ["doc_id"], SHARDS)


@query("op5_feistel_pseudonyms")
def _op5(table):
    """Every document with its personal data replaced, and what was found."""
    return pii.replace(table("documents").select("doc_id", "text"), QUERY_KEY, kinds="kinds", found="n_found")


@query("op6_simhash_near_duplicates")
def _op6(table):
    return simhash.near_duplicates(table("documents").select("doc_id", "text"))


_WORDS = (
    "regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
    "'[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
)
_CONTAMINATION_SQL = f"""
WITH d AS (SELECT doc_id, coalesce({_WORDS.format("text")}, []) AS words FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS.format("text")} AS words FROM benchmark),
w AS (
  SELECT DISTINCT item, least(len(words), 13) AS n, array_to_string(words[i:i + 12], ' ') AS win
  FROM (SELECT item, words, unnest(range(1, greatest(len(words) - 12, 1) + 1)) AS i FROM b WHERE len(words) > 0)),
g AS (
  SELECT doc_id, i, n, array_to_string(words[i:i + n - 1], ' ') AS win
  FROM (SELECT doc_id, words, n, unnest(range(1, len(words) - n + 2)) AS i
        FROM d CROSS JOIN (SELECT DISTINCT n FROM w) WHERE len(words) >= n)),
hit AS (SELECT g.doc_id, g.i, g.n, w.item FROM g JOIN w ON g.win = w.win AND g.n = w.n),
pos AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit
  FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
its AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(words) AS contaminated
FROM d LEFT JOIN pos ON d.doc_id = pos.doc_id LEFT JOIN its ON d.doc_id = its.doc_id"""


@query("op7_wu_manber_decontamination", _CONTAMINATION_SQL)
def _op7(table):
    found = decontam.occurrences(table("documents").select("doc_id", "text"), decontam.publish(table("benchmark")))
    return found.select(
        "doc_id",
        "found.n_words",
        "found.n_hit",
        F.size("found.items").cast("bigint").alias("n_items"),
        decontam.items_digest(F.col("found.items")).alias("items_sha256"),
        decontam.contaminated().alias("contaminated"),
    )


@query("op8_tag_path_extraction")
def _op8(table):
    found = tagpath.extract(table("pages").select("page_id", "url", "html"))
    return found.select("page_id", "url", "text", F.char_length("text").cast("bigint").alias("n_chars"))


_VECTOR_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e, len(embedding) AS size,
    embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0 AS good
  FROM embeddings),
u AS (SELECT vec_id, size, e, sqrt(list_dot_product(e, e)) AS norm FROM v WHERE good),
link AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.size = b.size AND a.vec_id <> b.vec_id
  WHERE list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.95),
reach AS (
  SELECT vec_id AS node, vec_id AS seen FROM v
  UNION
  SELECT reach.node, link.b FROM reach JOIN link ON reach.seen = link.a),
least AS (SELECT node, min(seen) AS component_id FROM reach GROUP BY node),
counted AS (SELECT a, count(*) AS n FROM link GROUP BY a)
SELECT v.vec_id, coalesce(n, 0) AS n_links, component_id, component_id = v.vec_id AS kept
FROM v JOIN least ON v.vec_id = least.node LEFT JOIN counted ON v.vec_id = counted.a"""


@query("op9_cover_tree_near_duplicates", _VECTOR_SQL)
def _op9(table):
    return covertree.near_duplicates(table("embeddings"))


@query("op10_site_relative_line_dedup", linededup.reference_sql("doc_id, source, text, n_lines, n_dropped"))
def _op10(table):
    pages = table("documents").select("doc_id", "source", "text")
    return linededup.without_boilerplate(pages, n_lines="n_lines", n_dropped="n_dropped")


@query("op11_interval_alignment")
def _op11(table):
    """Every document's tokens by two public tokenizers, aligned, with corpus-wide counts of linked ids."""
    paths = vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model")
    return alignment.aligned(table("documents"), *paths, columns=["doc_id"])


_LEAF = " || ".join(f"coalesce(CAST(strlen(CAST({c} AS VARCHAR)) AS VARCHAR) || ':' || CAST({c} AS VARCHAR), '-')" for c in ("doc_id", "source", "lang", "n_chars", "{text}"))
_BITS = "flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: list_transform(range(8), lambda i: (ascii(c) >> i) & 1)))"
# One bit of the message after another, lowest first; only the last bit of the checksum matters.
_CRC = f"xor(list_reduce(list_prepend(4294967295, {_BITS}), lambda a, b: xor(a >> 1, 3988292384 * (xor(a, b) & 1))), 4294967295)"
#: Levels that the reference SQL spells out; three to this power rows a source, and sources, at most.
_SQL_LEVELS = 14


def _merkle_level(k: int) -> str:
    return f"""
n{k + 1} AS MATERIALIZED (
  SELECT g, pos // 3 AS pos, CASE WHEN cnt = 1 THEN min(digest) ELSE sha256(string_agg(digest, '' ORDER BY pos)) END AS digest,
    (cnt + 2) // 3 AS cnt
  FROM n{k} GROUP BY g, pos // 3, cnt),
f{k + 1} AS MATERIALIZED (
  SELECT f.row, f.g, f.pos // 3 AS pos,
    CASE WHEN n.cnt = 1 THEN min(f.folded) ELSE sha256(string_agg(CASE WHEN n.pos = f.pos THEN f.folded ELSE n.digest END, '' ORDER BY n.pos)) END AS folded,
    f.others || coalesce(string_agg(n.digest, '' ORDER BY n.pos) FILTER (WHERE n.pos <> f.pos), '') AS others
  FROM f{k} f JOIN n{k} n ON f.g IS NOT DISTINCT FROM n.g AND f.pos // 3 = n.pos // 3
  GROUP BY f.row, f.g, f.pos // 3, n.cnt, f.others)"""


_MERKLE_SQL = f"""
WITH leaf AS MATERIALIZED (
  SELECT doc_id, source, sha256({_LEAF.format(text="text")}) AS leaf,
    sha256({_LEAF.format(text=f"CASE WHEN coalesce({_CRC} % 2 = 0, false) THEN replace(text, chr(10), '') ELSE text END")}) AS given
  FROM documents),
placed AS MATERIALIZED (
  SELECT *, row_number() OVER (ORDER BY source NULLS FIRST, doc_id NULLS FIRST, leaf) AS row,
    row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
    count(*) OVER (PARTITION BY source) AS cnt
  FROM leaf),
n0 AS MATERIALIZED (SELECT source AS g, pos, leaf AS digest, cnt FROM placed),
f0 AS MATERIALIZED (SELECT row, source AS g, pos, given AS folded, '' AS others FROM placed),
{",".join(_merkle_level(k) for k in range(_SQL_LEVELS))},
n{_SQL_LEVELS + 1} AS MATERIALIZED (
  SELECT true AS g, row_number() OVER (ORDER BY g NULLS FIRST) - 1 AS pos, digest, count(*) OVER () AS cnt, g AS source FROM n{_SQL_LEVELS}),
f{_SQL_LEVELS + 1} AS MATERIALIZED (
  SELECT f.row, true AS g, n.pos, f.folded, f.others
  FROM f{_SQL_LEVELS} f JOIN n{_SQL_LEVELS + 1} n ON f.g IS NOT DISTINCT FROM n.source),
{",".join(_merkle_level(k) for k in range(_SQL_LEVELS + 1, 2 * _SQL_LEVELS + 1))}
SELECT doc_id, leaf, s.digest AS subroot, r.digest AS root, sha256(others) AS proof_sha256, folded AS folded_root, folded = r.digest AS verified
FROM placed p JOIN f{2 * _SQL_LEVELS + 1} f ON p.row = f.row JOIN n{_SQL_LEVELS} s ON p.source IS NOT DISTINCT FROM s.g, n{2 * _SQL_LEVELS + 1} r"""


@query("op12_merkle_manifest", _MERKLE_SQL)
def _op12(table):
    """Every document's leaf and proof, checked against a copy that lost the line ends of some texts."""
    even = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.lit(False))
    handed_in = F.when(even, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    tree = merkle.build(table("documents"), ["doc_id", "source", "lang", "n_chars", "text"], "source", ["doc_id"], given={"text": handed_in})
    return tree.verify()


_NAMES = "|".join("".join(f"[{c}{c.upper()}]" for c in w) for w in ("password", "passwd", "secret", "token"))
_RE2_ASSIGN = f"({_NAMES}|[aA][pP][iI]_?[kK][eE][yY])[\"'']?\\x20*[:=]\\x20*[\"'']?([A-Za-z0-9+/_.=-]+)"


def _found_sql(rank: int, kind: str, pattern: str, test: str = "true") -> str:
    return f"""
SELECT doc_id, {rank} AS rank, '{kind}' AS kind, ms[i] AS m,
  list_sum(list_transform(ps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0) AS start
FROM (SELECT *, unnest(range(1, len(ms) + 1)) AS i
      FROM (SELECT doc_id, regexp_split_to_array(text, '{pattern}') AS ps, regexp_extract_all(text, '{pattern}') AS ms FROM d))
WHERE {test}"""


def _secrets_sql() -> str:
    base = [_found_sql(0, "assign", _RE2_ASSIGN, f"length(regexp_extract(ms[i], '{_RE2_ASSIGN}', 2)) >= 8")]
    base += [_found_sql(1, "access", secretscan.FORMATS["access"][0]), _found_sql(2, "hex", secretscan.FORMATS["hex"][0])]
    w = secretscan.WINDOW
    fine = " AND ".join("NOT regexp_matches(ms[i], '{}')".format(a.replace("'", "''")) for a in secretscan.ALLOWED)
    runs = [_found_sql(3 + k, kind, f"[{c}]{{{w},}}", fine) for k, (kind, (c, _)) in enumerate(secretscan.CLASSES.items())]
    limits = ", ".join(f"('{kind}', {secretscan.largest_sum(w, bits)})" for kind, (_, bits) in secretscan.CLASSES.items())
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
base AS (SELECT doc_id, rank, kind, start, start + length(m) AS stop FROM ({" UNION ALL ".join(base)})),
run AS MATERIALIZED (SELECT *, row_number() OVER () AS r FROM ({" UNION ALL ".join(runs)})),
win AS (SELECT r, o, unnest(string_split(substr(m, CAST(o AS INTEGER) + 1, {w}), '')) AS c FROM (SELECT r, m, unnest(range(0, length(m) - {w - 1})) AS o FROM run)),
counted AS (SELECT r, o, c, count(*) AS n FROM win GROUP BY r, o, c),
summed AS (SELECT r, o, sum(({secretscan.terms(w)})[n + 1]) AS total FROM counted GROUP BY r, o),
good AS (
  SELECT run.*, o FROM run JOIN summed ON run.r = summed.r JOIN (VALUES {limits}) AS l(kind, most) ON run.kind = l.kind WHERE total <= most),
marked AS (SELECT *, CASE WHEN o - lag(o) OVER (PARTITION BY r ORDER BY o) <= {w} THEN 0 ELSE 1 END AS first FROM good),
island AS (SELECT *, sum(first) OVER (PARTITION BY r ORDER BY o) AS part FROM marked),
more AS (SELECT doc_id, rank, kind, start + min(o) AS start, start + max(o) + {w} AS stop FROM island GROUP BY doc_id, rank, kind, r, start, part),
every AS (
  SELECT * FROM base UNION ALL
  SELECT * FROM more WHERE NOT EXISTS (SELECT 1 FROM base WHERE base.doc_id = more.doc_id AND base.start <= more.start AND base.stop >= more.stop)),
told AS (
  SELECT doc_id, count_if(kind = 'assign') AS n_assign, count_if(kind = 'access') AS n_access, count_if(kind = 'hex') AS n_hex,
    string_agg(kind || ':' || CAST(start AS BIGINT) || ':' || CAST(stop AS BIGINT), ',' ORDER BY start, rank, stop) AS spans,
    string_agg(kind || ':' || CAST(start AS BIGINT) || ':' || CAST(stop AS BIGINT), ',' ORDER BY start, rank, stop) FILTER (WHERE rank < 3) AS known
  FROM every GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n_assign, 0) AS BIGINT) AS n_assign, CAST(coalesce(n_access, 0) AS BIGINT) AS n_access,
  CAST(coalesce(n_hex, 0) AS BIGINT) AS n_hex, sha256(coalesce(known, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN told ON d.doc_id = told.doc_id"""


@query("op13_entropy_secret_scan", _secrets_sql())
def _op13(table):
    """Every document's secrets: numbers of each known format, and all spans."""
    found = secretscan.find(table("documents").select("doc_id", "text"), found="found")
    counts = [F.expr(f"CAST(size(filter(found, x -> x.kind = '{kind}')) AS BIGINT)").alias(f"n_{kind}") for kind in secretscan.FORMATS]
    base = F.sha2(F.expr(secretscan.listed("found", base_only=True)).cast("binary"), 256).alias("base_sha256")
    return found.select("doc_id", *counts, base, F.expr(secretscan.listed("found")).alias("spans"))
