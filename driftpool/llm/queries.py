"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from driftpool.llm import (
    bit_search, bpe, conversation_repair, jaccard_join, language_id, line_dedup, merkle, packing, spelling, suffix_dedup, super_minhash, token_files,
    url_templates,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(build):
        QUERIES[build.__name__] = build
        if sql:
            SQL[build.__name__] = sql
        return build

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query()
def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts without the bytes of 200-byte strings that occur again."""
    left = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return left.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]


@query(r"""
WITH RECURSIVE cut AS (
  SELECT page_id, instr(url, '://') > 0 AS there, substring(url, instr(url, '://') + 3) AS rest FROM pages
), split AS (
  SELECT page_id,
    CASE WHEN there THEN translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
    CASE WHEN there THEN regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path
  FROM cut
), shaped AS (
  SELECT *, regexp_replace(regexp_replace(regexp_replace(regexp_replace(path,
    '\b(?:[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}|[0-9A-Fa-f]{16,})\b', '%', 'g'), '[0-9]+', '#', 'g'), '/+', '/', 'g'), '/\z', '') AS shape,
    TRY_CAST(regexp_extract(path, '/([0-9]{1,18})(?:[.]html|/)?\z', 1) AS BIGINT) AS number
  FROM split
), labelled AS (
  SELECT page_id, quality = 1 AND toxic = 0 AS good FROM shaped JOIN labels ON number = doc_id WHERE (quality = 1 AND toxic = 0) IS NOT NULL
), known AS (
  SELECT host, shape, count(*) AS n, count(good) AS n_labelled, count(*) FILTER (WHERE good) AS n_good
  FROM shaped LEFT JOIN labelled USING (page_id) GROUP BY host, shape
), total AS (
  SELECT coalesce(sum(n_good)::DOUBLE / nullif(sum(n_labelled), 0), 1.0) AS base FROM known
), parts AS (
  SELECT host, shape, n, [x FOR x IN string_split(shape, '/') IF x <> ''] AS p FROM known
), levels AS (
  SELECT host, shape, n, p, 0 AS d, '' AS node FROM parts
  UNION ALL
  SELECT host, shape, n, p, d + 1, node || '/' || CASE WHEN fan > 32 AND pages * 32 < everything THEN '*' ELSE segment END
  FROM (
    SELECT *, sum(n) OVER (PARTITION BY host, node, segment) AS pages, sum(n) OVER (PARTITION BY host, node) AS everything,
      count(DISTINCT segment) OVER (PARTITION BY host, node) AS fan
    FROM (SELECT *, p[d + 1] AS segment FROM levels WHERE d < len(p))
  )
), nodes AS (
  SELECT host, shape, d AS depth, node FROM levels
), stats AS (
  SELECT host, depth, node, CASE WHEN depth = 0 THEN '' ELSE regexp_replace(node, '/[^/]*\z', '') END AS above,
    sum(n_labelled)::DOUBLE AS n, sum(n_good)::DOUBLE AS good
  FROM nodes JOIN known USING (host, shape) GROUP BY host, depth, node
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY host, depth, above ORDER BY good / n, node) AS r FROM stats WHERE n > 0
), merged AS (
  SELECT host, depth, above, node, r, 1 AS g, n, good FROM ranked WHERE r = 1
  UNION ALL
  SELECT host, depth, above, node, r, CASE WHEN apart THEN g + 1 ELSE g END, CASE WHEN apart THEN n ELSE all_n END, CASE WHEN apart THEN good ELSE all_good END
  FROM (
    SELECT k.*, m.g, m.n + k.n AS all_n, m.good + k.good AS all_good, abs(k.good / k.n - m.good / m.n) > 0.5 * (1 / m.n + 1 / k.n)
      + 2 * sqrt((m.good + k.good) / (m.n + k.n) * (1 - (m.good + k.good) / (m.n + k.n)) * (1 / m.n + 1 / k.n)) AS apart
    FROM merged m JOIN ranked k ON k.host = m.host AND k.depth = m.depth AND k.above = m.above AND k.r = m.r + 1
  )
), grouped AS (
  SELECT s.*, coalesce(g, 0) AS g FROM stats s LEFT JOIN (SELECT host, depth, node, g FROM merged) USING (host, depth, node)
), branches AS (
  SELECT host, depth, node, CASE WHEN depth = 0 THEN '' ELSE above || '/~' || g END AS branch, sum(n) OVER w AS n, sum(good) OVER w AS good
  FROM grouped WINDOW w AS (PARTITION BY host, depth, above, g)
), ends AS (
  SELECT host, shape, arg_max(node, depth) AS template FROM nodes GROUP BY host, shape
), chains AS (
  SELECT DISTINCT host, template, depth, branch, b.n, b.good
  FROM ends JOIN nodes USING (host, shape) JOIN branches b USING (host, depth, node)
), folded AS (
  SELECT host, template, 0 AS depth, branch AS node, n, good FROM chains WHERE depth = 0
  UNION ALL
  SELECT c.host, c.template, c.depth, CASE WHEN other THEN c.branch ELSE c.node END, CASE WHEN other THEN c.n ELSE c.old_n END,
    CASE WHEN other THEN c.good ELSE c.old_good END
  FROM (
    SELECT c.*, f.node, f.n AS old_n, f.good AS old_good,
      f.n = 0 OR abs(c.good - c.n * ((f.good + base) / (f.n + 1)))
        > 2 * sqrt(c.n * ((f.good + base) / (f.n + 1)) * (1 - (f.good + base) / (f.n + 1))) + 0.5 AS other
    FROM folded f JOIN chains c ON c.host = f.host AND c.template = f.template AND c.depth = f.depth + 1, total
  ) c
), judged AS (
  SELECT host, template, arg_max(node, depth) AS judged_by, (arg_max(good, depth) + base * 10) / (arg_max(n, depth) + 10) AS score
  FROM folded, total GROUP BY host, template, base
), ruled AS (
  SELECT *, CASE
    WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/en/1') THEN 'example.org/en/1'
    WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/es/') THEN 'example.org/es/'
    WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/fr/') THEN 'com/fr/'
    WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/de/') THEN 'com/de/'
    WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/') THEN 'org/' END AS rule
  FROM shaped
)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
  WHEN score < 0.5 THEN 'block' ELSE 'allow' END AS verdict, template, judged_by, round(score, 9) AS score
FROM ruled JOIN ends USING (host, shape) JOIN judged USING (host, template)""")
def op2_url_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page by rules, else by its template. A page is labelled if its path ends in the number of a labelled document."""
    pages, labels = table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels")
    path = url_templates.host_and_path(F.col("url"))[1]
    number = F.regexp_extract(path, "/([0-9]{1,18})(?:[.]html|/)?\\z", 1).try_cast("long")
    good = F.expr("quality = 1 AND toxic = 0")
    known = pages.select("page_id", number.alias("doc_id")).join(labels.select("doc_id", good.alias("good")), "doc_id").select("page_id", "good")
    found = url_templates.judge(pages, known, RULES)
    return found.select("page_id", "host", "path", "rule", "verdict", "template", "judged_by", F.round("score", 9).alias("score"))


@query()
def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of all documents, written as framed records and read back."""
    manifest = token_files.write_records(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    records = token_files.read_records(manifest)
    return records.select("doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


@query()
def op4_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all texts and of their edited texts, and how near those and the next document are."""
    return merkle.compare_with_next(table(spark, sf_dir, "documents"))


@query()
def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-level ids of all documents and the texts that they decode to."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    decoded = bpe.decode(bpe.encode(table(spark, sf_dir, "documents"), path), path)
    return decoded.select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"),
    )


@query()
def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in windows of 2048 tokens."""
    pieces = packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@query()
def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all documents, learned from those outside the held-out fold."""
    docs = table(spark, sf_dir, "documents")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    model = language_id.train(docs.filter(~held_out))
    found = language_id.predict(docs, model)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


@query()
def op8_bit_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors of every twentieth vector."""
    vectors = table(spark, sf_dir, "embeddings")
    return bit_search.nearest(vectors, vectors.filter("vec_id % 20 = 0"))


@query()
def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all documents and the links of each."""
    found = jaccard_join.near_groups(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "class_id", "same_id", "n_links")


@query("""
WITH lines AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents
), numbered AS (
  SELECT doc_id, len(parts) AS n_lines, unnest(parts) AS line, unnest(range(1, len(parts) + 1)) AS k FROM lines
), keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz') AS key FROM numbered
), holders AS (
  SELECT key, min(doc_id) AS holder FROM keyed WHERE length(key) >= 10 GROUP BY key
), judged AS (
  SELECT keyed.*, coalesce(holder < doc_id, false) AS gone FROM keyed LEFT JOIN holders USING (key)
)
SELECT doc_id, CAST(any_value(n_lines) AS BIGINT) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY k) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id""")
def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines seen in an earlier document go."""
    docs = table(spark, sf_dir, "documents")
    report = line_dedup.kept_report(docs, line_dedup.keep_bitmaps(docs))
    return report.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


# -- CRC-32 in SQL: a byte's eight steps as a table, then one look-up per byte of the text ------

CRC = """polynomial AS (
  SELECT [list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) FOR i IN range(256)] AS steps
)"""


def crc(text: str) -> str:
    """SQL for the unsigned CRC-32 of the UTF-8 bytes of ``text``, whose code points are below 2048."""
    points = f"flatten([CASE WHEN ord(c) < 128 THEN [ord(c)::BIGINT] ELSE [192 + (ord(c) >> 6), 128 + (ord(c) & 63)] END FOR c IN string_split({text}, '')])"
    return f"xor(list_reduce({points}, lambda r, b: xor(r >> 8, steps[xor(r & 255, b) + 1]), 4294967295), 4294967295)"


@query(f"""
WITH RECURSIVE {CRC}, runs AS (
  SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\\x{{00C0}}-\\x{{00FF}}]+')) AS run FROM documents
), lowered AS (
  SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS n
  FROM runs WHERE length(run) >= 6 GROUP BY ALL
), hashed AS (
  SELECT run, n, {crc("doc_id || ':' || run")} AS h FROM lowered, polynomial
), words AS (
  SELECT CASE WHEN h % 199 = 0 THEN left(run, h % length(run)) || substring(run, h % length(run) + 2) ELSE run END AS word, sum(n)::BIGINT AS n
  FROM hashed GROUP BY 1 HAVING length(word) >= 6 AND sum(n) >= 5
), rests AS (
  SELECT word, n, i, left(word, i - 1) || substring(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)
), pairs AS (
  SELECT a.word AS u, b.word AS v, b.n FROM rests a JOIN rests b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM words a JOIN rests b ON a.word = b.rest
  UNION SELECT b.word, a.word, a.n FROM words a JOIN rests b ON a.word = b.rest
), near AS (
  SELECT u AS word, count(*) AS n_near, max(n) AS best_n FROM pairs GROUP BY u
), best AS (
  SELECT u AS word, min(v) AS best FROM pairs JOIN near ON u = word AND n = best_n GROUP BY u
), judged AS (
  SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN best_n >= 5 * n THEN best END AS form, CASE WHEN best_n >= 5 * n THEN best_n END AS form_n
  FROM words LEFT JOIN near USING (word) LEFT JOIN best USING (word)
), walk AS (
  SELECT word, word AS root, form AS next FROM judged
  UNION ALL
  SELECT w.word, w.next, j.form FROM walk w JOIN judged j ON j.word = w.next
)
SELECT j.word, j.form, w.root, j.n, j.n_near, j.form_n FROM judged j JOIN walk w ON w.word = j.word AND w.next IS NULL""")
def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents, their commoner spellings and how many words are near."""
    found = spelling.variants(table(spark, sf_dir, "documents"))
    return found.select("word", "form", "root", "n", "n_near", "form_n")


def _more(x: str, cost: int, edit: str) -> str:
    """SQL for a repair (its cost in nine digits, then its audit) with one more edit at the front."""
    return f"lpad((left({x}, 9)::BIGINT + {cost})::VARCHAR, 9, '0') || '{edit}' || substring({x}, 10)"


def _backwards() -> str:
    """SQL columns b0 to b3: the least repair of a conversation from row k on, by the state before it, from those behind it."""
    cut = "CASE WHEN r.fault = 'truncated' THEN 3 ELSE 0 END"
    step = {0: 2, 1: 2, 2: 3, 3: 2}
    edits = {}
    for p, q in step.items():
        keep = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}[p]
        kept = " ".join(f"WHEN r.initial = '{c}' THEN " + _more(f"b.b{to}", cut, "K") for c, to in keep.items())
        edits[p] = f"CASE WHEN r.fault IN ('blank', 'duplicate') THEN {_more(f'b.b{p}', 4, 'D')} ELSE least({_more(f'b.b{p}', 4, 'D')}, {_more(f'b.b{q}', '3 + ' + cut, 'R')}, CASE {kept} END) END"
    one = ", ".join(f"{edits[p]} AS e{p}" for p in step)
    closed = ["least(e0, {i2}, {ii3})", "least(e1, {i2}, {ii3})", "least(e2, {i3})", "least(e3, {i2})"]
    closed = ", ".join(c.format(i2=_more("e2", 3, "I"), i3=_more("e3", 3, "I"), ii3=_more("e3", 6, "II")) + f" AS b{p}" for p, c in enumerate(closed))
    return f"SELECT conv_id, k, {closed} FROM (SELECT b.conv_id, r.k, {one} FROM back b JOIN marked r ON r.conv_id IS NOT DISTINCT FROM b.conv_id AND r.k = b.k - 1)"


@query(f"""
WITH RECURSIVE {CRC}, kinds AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    {crc("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS kind FROM conversations, polynomial
), damaged AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM kinds
), placed AS (
  SELECT *, left(role, 1) AS initial, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS k,
    rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS core FROM damaged
), marked AS (
  SELECT *, CASE WHEN core = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY k) > 1 THEN 'duplicate'
    WHEN right(core, 1) NOT IN ('.', '!', '?') THEN 'truncated' END AS fault,
    lag(initial) OVER (PARTITION BY conv_id ORDER BY k) || initial AS meeting FROM placed
), totals AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
    count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
    count(*) FILTER (meeting NOT IN ('su', 'ua', 'au')) AS illegal, max(k) AS n FROM marked GROUP BY conv_id
), back AS (
  SELECT conv_id, n + 1 AS k, '000000000' AS b0, '000000006II' AS b1, '000000003I' AS b2, '000000000' AS b3 FROM totals
  UNION ALL
  {_backwards()}
), repairs AS (
  SELECT conv_id, left(b0, 9)::BIGINT AS cost, substring(b0, 10) AS audit FROM back WHERE k = 1
), letters AS (
  SELECT conv_id, i, audit[i] AS edit, i - count(*) FILTER (audit[i] = 'I') OVER w AS k, count(*) FILTER (audit[i] <> 'D') OVER w AS j
  FROM (SELECT conv_id, audit, unnest(range(1, length(audit) + 1)) AS i FROM repairs) WINDOW w AS (PARTITION BY conv_id ORDER BY i)
), lines AS (
  SELECT l.*, m.role, m.initial, m.text, bool_or(j = 1 AND edit = 'K' AND initial = 's') OVER (PARTITION BY l.conv_id) AS opened
  FROM letters l LEFT JOIN marked m ON m.conv_id IS NOT DISTINCT FROM l.conv_id AND m.k = l.k AND edit <> 'I' WHERE edit <> 'D'
), hashes AS (
  SELECT conv_id, sha256(string_agg(CASE WHEN edit = 'K' THEN role WHEN (j - coalesce(opened, false)::INT) % 2 = 1 THEN 'user' ELSE 'assistant' END
    || ':' || coalesce(text, ''), chr(10) ORDER BY i)) AS digest FROM lines GROUP BY conv_id
)
SELECT c.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, coalesce(digest, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN totals t ON t.conv_id IS NOT DISTINCT FROM c.conv_id
  LEFT JOIN repairs r ON r.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN hashes h ON h.conv_id IS NOT DISTINCT FROM c.conv_id""")
def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations after damage: their faults and the cheapest repair."""
    return conversation_repair.repair(conversation_repair.damaged(table(spark, sf_dir, "conversations")))


@query(r"""
WITH RECURSIVE worded AS (
  SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS (
  SELECT r, doc_id, CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_sort(list_distinct([array_to_string(w[i : i + 3], ' ') FOR i IN range(1, len(w) - 2)])) END AS s FROM worded
), named AS (
  SELECT r, doc_id, len(s) AS n, CASE WHEN len(s) > 0 THEN md5(array_to_string(s, chr(10))) ELSE 'row ' || r END AS class, s FROM sets
), classes AS (
  SELECT class, any_value(n) AS n, any_value(s) AS s, min(doc_id) AS doc_id FROM named GROUP BY class
), grams AS (
  SELECT class, n, unnest(s) AS gram FROM classes
), links AS (
  SELECT a.class AS x, b.class AS y FROM grams a JOIN grams b ON a.gram = b.gram AND a.class <> b.class AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
  GROUP BY a.class, a.n, b.class, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
), reached AS (
  SELECT class AS x, class AS y FROM classes
  UNION
  SELECT r.x, l.y FROM reached r JOIN links l ON r.y = l.x
), components AS (
  SELECT x AS class, min(doc_id) AS component_id FROM reached JOIN classes ON y = class GROUP BY x
)
SELECT doc_id, n AS n_shingles, component_id, coalesce(doc_id = component_id, false) AS kept FROM named JOIN components USING (class)""")
def op13_super_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents."""
    return super_minhash.near_groups(table(spark, sf_dir, "documents"))
