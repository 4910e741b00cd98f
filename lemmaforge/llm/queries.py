"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_pairs, chat, decontamination, fingerprints, jaccard_join, licenses, memory, mixing, quality, repair, spelling, token_files, toxicity, url_filter


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    memory.bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join(table(spark, sf_dir, "documents"))


OP1_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, hash(g) AS g FROM (SELECT DISTINCT doc_id, array_to_string(w[j + 1 : j + 5], ' ') AS g FROM (SELECT doc_id, w, unnest(range(greatest(1, len(w) - 4))) AS j FROM d WHERE len(w) > 0))),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
both_ AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM both_ JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
reach(a, b) AS (SELECT a, b FROM link UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, CAST(least(d.doc_id, coalesce(m.b, d.doc_id)) AS BIGINT) AS component_id
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT a AS doc_id, min(b) AS b FROM reach GROUP BY a) m USING (doc_id)
"""


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.plan(table(spark, sf_dir, "documents"))
    return plan.select("doc_id", "size", "source_size", "target", "taken")


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def _op3_sql(k: int = licenses.K) -> str:
    """The scan over grams as text: template positions as a table of values."""
    rows = [f"({n}, '{label}', {base}, {len(w) - k + 1}, {q}, '{' '.join(w[q : q + k])}')" for n, (label, base, w) in enumerate(licenses.templates(k)) for q in range(len(w) - k + 1)]
    gram = " || ' ' || ".join(f"w[p + {i + 1}]" for i in range(k))
    return rf"""
WITH t(n, label, base, size, q, g) AS (VALUES {", ".join(rows)}),
d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
pos AS (SELECT r, w, unnest(range(len(w) - {k - 1})) AS p FROM d WHERE len(w) >= {k}),
line AS (SELECT r, n, label, base, size, p - q AS diagonal, min(p) AS low, max(p) AS high, bit_or(1::BIGINT << q) AS voted FROM (SELECT r, p, {gram} AS g FROM pos) JOIN t USING (g) GROUP BY ALL),
cut AS (SELECT *, base OR lag(diagonal) OVER o IS NULL OR diagonal - lag(diagonal) OVER o > {licenses.NEAR_DIAGONALS} OR (lag(voted) OVER o & voted) <> 0 AS apart FROM line WINDOW o AS (PARTITION BY r, n ORDER BY diagonal)),
named AS (SELECT *, sum(apart::INT) OVER (PARTITION BY r, n ORDER BY diagonal ROWS UNBOUNDED PRECEDING) AS span FROM cut),
span AS (SELECT r, label, base, size, min(low) AS first, max(high) AS last, bit_count(bit_or(voted)) AS votes FROM named GROUP BY r, n, label, base, size, span),
c AS (SELECT *, votes / greatest(size, last - first + 1) AS cover, base AND votes = size AS entire FROM span)
SELECT doc_id, CAST(len(any_value(w)) AS BIGINT) AS n_words, count(*) FILTER (entire) AS n_base, min(first) FILTER (entire) AS first_word, max(first) FILTER (entire) AS last_word,
       coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (entire), '') AS base_labels,
       coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (entire OR (NOT base AND cover >= {licenses.LEAST_COVER})), '') AS labels, coalesce(max(cover), 0.0) AS score
FROM d LEFT JOIN c USING (r) GROUP BY r, doc_id
"""


OP3_SQL = _op3_sql()


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.report(table(spark, sf_dir, "documents"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.scores(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


#: The rules that the query judges by, and the globs of its own.
URL_RULES = (
    url_filter.Rule("allow", "com", "/"),
    url_filter.Rule("block", "example.com", "/en/"),
    url_filter.Rule("allow", "www.example.com", "/en/"),
    url_filter.Rule("block", "net", "/es/"),
    url_filter.Rule("block", "net", "/fr/"),
)
#: Words that mark a host wherever they stand in it, and those that do as a part between dots and hyphens.
URL_CONTAINS = "casino roulette blackjack jackpot sportsbook porn hentai xvideo escort camgirl viagra cialis tramadol phentermine cheap-pills payday-loan replica-watch free-bets clickbait malware phishing keygen warez popunder doubleclick adserver".split()
URL_PARTS = "ad ads adult xxx sex nude milf bet bets betting poker slots lottery pills pharma track tracker tracking spam banner crack torrent phish scam".split()
#: Ends of paths that hold no text, and folders of scripts, logins and counters.
URL_ENDS = ".exe .msi .dmg .apk .iso .zip .rar .7z .gz .tar .jpg .jpeg .png .gif .webp .ico .mp3 .mp4 .avi .mov .css .js .woff .woff2".split()
URL_FOLDERS = "cgi-bin wp-login.php wp-admin adserver trackback counter popup".split()


def url_globs() -> list[str]:
    hosts = [f"*{x}*" for x in URL_CONTAINS]
    hosts += [f"{before}{x}{behind}" for x in URL_PARTS for before in ("", "*.", "*-") for behind in ("", ".*", "-*")]
    paths = [f"**/**{x}" for x in URL_ENDS] + [g for x in URL_FOLDERS for g in (f"**/{x}", f"**/{x}/**")]
    return [g for x in hosts for g in (x, f"{x}/**")] + paths


URL_OWN = tuple(url_filter.Rule("block", glob=x) for x in url_globs())


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"), URL_RULES, URL_OWN)


OP5_SQL = f"""
WITH u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id,
        translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r AS (SELECT *, CASE
        WHEN (host = 'www.example.com' OR ends_with(host, '.www.example.com')) AND starts_with(path, '/en/') THEN 'www.example.com/en/'
        WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/en/') THEN 'example.com/en/'
        WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/es/') THEN 'net/es/'
        WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/fr/') THEN 'net/fr/'
        WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/') THEN 'com/' END AS rule FROM p)
SELECT CAST(page_id AS BIGINT) AS page_id, host, path, rule, CASE
        WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow'
        WHEN rule IS NOT NULL THEN 'block'
        WHEN regexp_matches(host, '{"|".join(URL_CONTAINS)}') OR regexp_matches(host, '(^|[.-])({"|".join(URL_PARTS)})([.-]|$)') THEN 'block'
        WHEN regexp_matches(path, '(?s)/.*({"|".join(x.replace(".", "[.]") for x in URL_ENDS)})$') OR regexp_matches(path, '/({"|".join(x.replace(".", "[.]") for x in URL_FOLDERS)})(/|$)') THEN 'block'
        ELSE 'allow' END AS verdict
FROM r
"""


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP7_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
placed AS (SELECT item_id, j, array_to_string(w[j + 1 : j + 10], ' ') AS g, least(10, len(w)) AS n FROM (SELECT item_id, w, unnest(range(greatest(1, len(w) - 9))) AS j FROM b WHERE len(w) > 0)),
win AS (SELECT DISTINCT item_id, g, n FROM placed),
sizes AS (SELECT DISTINCT n FROM win),
pos AS (SELECT r, w, n, unnest(range(len(w) - n + 1)) AS p FROM d, sizes WHERE len(w) >= n),
hit AS (SELECT r, p, pos.n, item_id FROM pos JOIN win ON win.n = pos.n AND win.g = array_to_string(w[p + 1 : p + pos.n], ' ')),
cover AS (SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT r, unnest(range(p, p + n)) AS q FROM hit) GROUP BY r),
longest AS (SELECT r, p0, count(*) + any_value(n) - 1 AS words, min(CAST(item_id AS VARCHAR)) AS item FROM (SELECT *, min(p) OVER (PARTITION BY r, item_id, d, g) AS p0 FROM (
  SELECT *, p - j AS d, p - row_number() OVER (PARTITION BY r, item_id, p - j ORDER BY p) AS g FROM (SELECT pos.r, pos.p, pos.n, w.item_id, w.j FROM pos JOIN placed w ON w.n = pos.n AND w.g = array_to_string(pos.w[p + 1 : p + pos.n], ' ')))) GROUP BY r, item_id, d, g, p0),
best AS (SELECT r, words, p0, item FROM longest QUALIFY row_number() OVER (PARTITION BY r ORDER BY words DESC, p0, item) = 1),
items AS (SELECT r, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS s FROM (SELECT DISTINCT r, item_id FROM hit) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated,
       CAST(coalesce(words, 0) AS BIGINT) AS longest_match, CAST(p0 AS BIGINT) AS longest_at, item AS longest_item
FROM d LEFT JOIN cover USING (r) LEFT JOIN items USING (r) LEFT JOIN best USING (r)
"""


#: The tools that the query knows.
TOOLS = [
    ("search", "query", "string", True),
    ("search", "limit", "integer", False),
    ("calculator", "expression", "string", True),
]


def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_messages(table(spark, sf_dir, "conversations"), spark.createDataFrame(TOOLS, chat.SCHEMA_COLUMNS))


OP8_SQL = """
SELECT conv_id, turn, role, turn AS after, CAST(0 AS INTEGER) AS step, CAST(NULL AS BIGINT) AS linked_turn, CAST(0 AS INTEGER) AS n_calls, '' AS problems,
       '{' || CASE WHEN text IS NULL THEN '' ELSE '"content":' || CAST(to_json(text) AS VARCHAR) || ',' END
           || CASE WHEN role IS NULL THEN '' ELSE '"role":' || CAST(to_json(role) AS VARCHAR) || ',' END || '"turn":' || turn || '}' AS json
FROM conversations
"""


def chat_tool_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The conversations' turns made calls and results: in order, results before their calls, and chains from the last turn to the first."""
    kind, turn = F.col("conv_id") % 3, F.col("turn").cast("string")
    call = lambda name, arguments: F.concat(F.lit('"tool_calls":[{"id":"c'), turn, F.lit(f'","name":"{name}","arguments":{arguments}}}]'))
    result = lambda step: F.concat(F.lit('"tool_call_id":"c'), (F.col("turn") + step).cast("string"), F.lit('"'))
    told = F.when(kind == 0, F.when(F.col("role") == "assistant", call("search", '{"query":"q","limit":"3"}')).when(F.col("role") == "user", F.concat(result(-1), F.lit(',"content":"r"'))))
    told = told.when(kind == 1, F.when(F.col("role") == "assistant", call("zap", "{}")).when(F.col("role") == "user", result(1)))
    told = told.otherwise(F.concat(call("search", "{}"), F.lit(","), result(1)))
    rows = table(spark, sf_dir, "conversations").withColumn("text", F.when(told.isNotNull(), F.concat(F.lit("{"), told, F.lit("}"))).otherwise("plain"))
    out = chat.format_messages(rows, spark.createDataFrame(TOOLS, chat.SCHEMA_COLUMNS))
    return out.select("conv_id", "turn", "role", "after", "step", "linked_turn", "n_calls", "problems")


CHAT_TOOL_LINKS_SQL = """
WITH c AS (SELECT conv_id, turn, role, conv_id % 3 AS kind, max(turn) OVER (PARTITION BY conv_id) AS last FROM conversations),
m AS (SELECT *, CASE WHEN kind = 2 THEN TRUE ELSE role = 'assistant' END AS calls,
        CASE WHEN kind = 2 THEN turn + 1 WHEN role = 'user' THEN CASE WHEN kind = 0 THEN turn - 1 ELSE turn + 1 END END AS of FROM c),
l AS (SELECT m.*, k.turn AS linked FROM m LEFT JOIN m k ON k.conv_id = m.conv_id AND k.turn = m.of AND k.calls)
SELECT conv_id, turn, role,
       CASE WHEN linked IS NULL THEN turn WHEN kind = 2 THEN last ELSE greatest(turn, linked) END AS after,
       CAST(CASE WHEN linked IS NULL THEN 0 WHEN kind = 2 THEN last - turn ELSE 1 END AS INTEGER) AS step,
       linked AS linked_turn, CAST(calls AS INTEGER) AS n_calls,
       concat_ws('; ', CASE WHEN calls THEN CASE kind WHEN 0 THEN 'type of limit' WHEN 1 THEN 'unknown tool zap' ELSE 'missing query' END END,
                       CASE WHEN of IS NOT NULL AND linked IS NULL THEN 'no call' END) AS problems
FROM l
"""


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.scores(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op10_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_output(table(spark, sf_dir, "documents"), tokenizer_path())


def op11_byte_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return byte_pairs.report(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


#: The 256 remainders of CRC-32 as a list in SQL.
CRC_STEPS = "list_transform(range(256), lambda b: list_reduce(range(8), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, b))"


def crc_sql(data: str) -> str:
    """Unsigned CRC-32 of a string's UTF-8 bytes; CRC_STEPS has to be in scope as ``steps``."""
    each = f"list_transform(range(0, length(hex(encode({data}))), 2), lambda i: CAST('0x' || substr(hex(encode({data})), i + 1, 2) AS BIGINT))"
    return f"xor(list_reduce({each}, lambda c, b: xor(steps[xor(c, b) % 256 + 1], c // 256), 4294967295), 4294967295)"


OP12_SQL = rf"""
WITH RECURSIVE crc AS (SELECT {CRC_STEPS} AS steps),
runs AS (SELECT doc_id, w, count(*) AS c FROM (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{{C0}}-\x{{FF}}]+')) AS w FROM documents) GROUP BY ALL),
h AS (SELECT w, c, {crc_sql("coalesce(CAST(doc_id AS VARCHAR), '') || ':' || w")} AS h FROM runs, crc),
word AS (SELECT CASE WHEN h % 97 = 0 THEN substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS word, CAST(sum(c) AS BIGINT) AS n FROM h GROUP BY 1 HAVING length(word) >= 5 AND sum(c) >= 3),
cut AS (SELECT word, n, i, substr(word, 1, i) AS a, substr(word, i + 2) AS b, substr(word, 1, i) || substr(word, i + 2) AS less FROM (SELECT word, n, unnest(range(length(word))) AS i FROM word)),
pair AS (SELECT x.word, y.word AS near, y.n AS near_n FROM cut x JOIN cut y ON x.i = y.i AND x.a = y.a AND x.b = y.b AND x.word <> y.word
  UNION SELECT c.word, w.word, w.n FROM cut c JOIN word w ON w.word = c.less
  UNION SELECT w.word, c.word, c.n FROM cut c JOIN word w ON w.word = c.less),
best AS (SELECT word, count(*) AS n_near, arg_min(near, printf('%019d', 9000000000000000000 - near_n) || near) AS near, max(near_n) AS near_n FROM pair GROUP BY word),
f AS (SELECT word, n, CASE WHEN near_n >= 2 * n THEN near END AS form, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 2 * n THEN near_n END AS form_n FROM word LEFT JOIN best USING (word)),
up(word, last, step) AS (SELECT word, word, 0 FROM f UNION ALL SELECT up.word, f.form, step + 1 FROM up JOIN f ON f.word = up.last WHERE f.form IS NOT NULL)
SELECT f.word, f.form, r.root, f.n, CAST(f.n_near AS BIGINT) AS n_near, f.form_n FROM f JOIN (SELECT word, arg_max(last, step) AS root FROM up GROUP BY word) r ON r.word = f.word
"""


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    return repair.report(repair.damage(rows), rows)


def _op13_sql() -> str:
    """The chart as a fold: an element of a list inserts or passes a row, and each item is cost, audit and repaired text in one string."""

    def more(v: str, cost: str, edit: str, line: str) -> str:
        """A value after one more edit; ``line`` is SQL or empty."""
        split = f"strpos({v}, chr(1))"
        return f"lpad(CAST(CAST(left({v}, 9) AS INTEGER) + {cost} AS VARCHAR), 9, '0') || substr({v}, 10, {split} - 10) || '{edit}' || substr({v}, {split})" + (f" || chr(10) || {line}" if line else "")

    insert = lambda v, role: more(v, "3", "I", f"'{role}:'")
    t = "3 * CAST(x.late AS INTEGER)"
    keep = lambda v, letter: f"CASE WHEN NOT x.must AND x.letter = '{letter}' THEN {more(v, t, 'K', 'x.line')} END"
    rerole = lambda v, role: f"""CASE WHEN NOT x.must AND x.letter <> '{role[0]}' THEN {more(v, f"(3 + {t})", "R", f"'{role}:' || x.text")} END"""
    delete = lambda v: more(v, "4", "D", "")
    shape = lambda kind, s, u, a, e: f"{{'kind': {kind}, 'letter': x.letter, 'must': x.must, 'late': x.late, 'text': x.text, 'line': x.line, 's': {s}, 'u': {u}, 'a': {a}, 'e': {e}}}"
    first = shape("x.kind", "acc.s", "acc.u", f"least(acc.a, {insert('acc.s', 'user')}, {insert('acc.u', 'user')}, {insert('acc.e', 'user')})", "acc.e")
    second = shape("x.kind", "acc.s", "acc.u", "acc.a", f"least(acc.e, {insert('acc.a', 'assistant')})")
    to_a = ", ".join(f"{keep(f'acc.{v}', 'u')}, {rerole(f'acc.{v}', 'user')}" for v in "sue")
    passed = shape("x.kind", delete("acc.s"), f"least({delete('acc.u')}, {keep('acc.s', 's')})", f"least({delete('acc.a')}, {to_a})", f"least({delete('acc.e')}, {keep('acc.a', 'a')}, {rerole('acc.a', 'assistant')})")
    empty = "CAST(NULL AS VARCHAR)"
    element = lambda kind, row: f"{{'kind': {kind}, 'letter': {row}letter, 'must': {row}must, 'late': {row}late, 'text': {row}text, 'line': {row}line, 's': {empty}, 'u': {empty}, 'a': {empty}, 'e': {empty}}}"
    constant = lambda kind, s: f"{{'kind': {kind}, 'letter': '', 'must': false, 'late': false, 'text': '', 'line': '', 's': {s}, 'u': {empty}, 'a': {empty}, 'e': {empty}}}"
    opening = ", ".join(constant(*x) for x in ((0, "'000000000' || chr(1)"), (0, empty), (1, empty)))
    return rf"""
WITH crc AS (SELECT {CRC_STEPS} AS steps),
m AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {crc_sql("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")} % 20 AS k FROM conversations, crc),
r AS (SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role, CASE k WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE WHEN k = 3 THEN 2 ELSE 1 END)) AS copy FROM m WHERE k <> 0),
b AS (SELECT *, left(role, 1) AS letter, role || ':' || text AS line, trim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS again, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS place FROM r),
f AS (SELECT *, bare = '' OR again AS must, bare <> '' AND NOT again AND right(bare, 1) NOT IN ('.', '!', '?') AS late, lag(letter) OVER (PARTITION BY conv_id ORDER BY place) || letter AS pair FROM b),
g AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (bare = '') AS blank, count(*) FILTER (bare <> '' AND again) AS duplicate, count(*) FILTER (late) AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal,
  list({element(2, "")} ORDER BY place) AS rows FROM f GROUP BY conv_id),
p AS (SELECT * EXCLUDE (rows), list_reduce(list_concat([{opening}],
    flatten(list_transform(rows, lambda x: [x, {element(0, "x.")}, {element(1, "x.")}]))), lambda acc, x: CASE x.kind WHEN 0 THEN {first} WHEN 1 THEN {second} ELSE {passed} END) AS last FROM g),
v AS (SELECT * EXCLUDE (last), least(last.s, last.e) AS v FROM p)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(coalesce(left(v, 9), '0') AS BIGINT) AS cost,
  coalesce(substr(v, 10, strpos(v, chr(1)) - 10), '') AS audit, sha256(coalesce(substr(v, strpos(v, chr(1)) + 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN v ON c.conv_id IS NOT DISTINCT FROM v.conv_id
"""


OP13_SQL = _op13_sql()


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ngram_jaccard_join": op1_ngram_jaccard_join,
    "op2_source_mixing": op2_source_mixing,
    "op3_license_scan": op3_license_scan,
    "op4_quality": op4_quality,
    "op5_url_filters": op5_url_filters,
    "op6_fingerprints": op6_fingerprints,
    "op7_benchmark_decontamination": op7_benchmark_decontamination,
    "op8_chat_formatting": op8_chat_formatting,
    "chat_tool_links": chat_tool_links,
    "op9_toxicity": op9_toxicity,
    "op10_token_output": op10_token_output,
    "op11_byte_pairs": op11_byte_pairs,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_conversation_repair": op13_conversation_repair,
}

SQL: dict[str, str] = {
    "op1_ngram_jaccard_join": OP1_SQL,
    "op3_license_scan": OP3_SQL,
    "op5_url_filters": OP5_SQL,
    "op7_benchmark_decontamination": OP7_SQL,
    "op8_chat_formatting": OP8_SQL,
    "op12_spelling_variants": OP12_SQL,
    "op13_conversation_repair": OP13_SQL,
    "chat_tool_links": CHAT_TOOL_LINKS_SQL,
}
