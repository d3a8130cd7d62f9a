"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from tilegrid.llm import decontam, importance, leaderboard, licenses, neardup, quality_rules
from tilegrid.llm.license_texts import KNOWN, SPELLINGS
from tilegrid.llm.mixing import LEVELS, Mix

_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def words(text: str) -> str:
    return rf"regexp_extract_all({text}, '[^\x20\x09-\x0D]+')"


def quality_rules_sql() -> str:
    q = quality_rules
    share = {"symbol_share": "n_symbols / greatest(word_chars, 1)", "dup_line_share": "n_dup_lines / greatest(n_lines, 1)", "repeat_share": "n_repeat_words / greatest(n_words, 1)", "mean_word": "word_chars / greatest(n_words, 1)"}
    fence = {m: f"quantile_disc({m}, 0.75) + {q.REACH} * greatest(quantile_disc({m}, 0.75) - quantile_disc({m}, 0.25), {least})" for m, least in q.MEASURES.items()}
    level = lambda key: f"SELECT {key}count(*) AS n, " + ", ".join(f"{f} AS {m}" for m, f in fence.items()) + " FROM shares WHERE NOT base_failed" + (f" GROUP BY {key[:-2]}" if key else "")
    best = ", ".join(f"CASE WHEN a.n >= {q.ENOUGH} THEN a.{m} WHEN b.n >= {q.ENOUGH} THEN b.{m} ELSE c.{m} END AS f_{m}" for m in share)
    return rf"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
parts AS (SELECT *, {words("text")} AS w, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM docs),
wins AS (SELECT r, i, array_to_string(w[i:i + 4], ' ') AS win FROM (SELECT r, w, unnest(range(1, len(w) - 3)) AS i FROM parts)),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, win) AS c FROM wins) WHERE c > 1),
rep AS (SELECT r, count(DISTINCT i + k) AS n FROM twice, range(5) AS t(k) GROUP BY r),
counts AS (
  SELECT r, doc_id, lang, source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words, len(lines) AS n_lines
  FROM parts LEFT JOIN rep USING (r)),
shares AS (SELECT *, {", ".join(f"{v} AS {k}" for k, v in share.items())}, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM counts),
leaf AS ({level("lang, source, ")}), bylang AS ({level("lang, ")}), whole AS ({level("")}),
judged AS (SELECT s.*, {best} FROM shares s LEFT JOIN leaf a USING (lang, source) LEFT JOIN bylang b USING (lang) CROSS JOIN whole c)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND {" AND ".join(f"NOT coalesce({m} > f_{m}, false)" for m in share)} AS kept
FROM judged"""


def _canonical(text: str) -> str:
    """Normalised lines: word by word where a spelling is one word, then pairs of words."""
    out = f"regexp_replace(translate(coalesce({text}, ''), '{_UP}', '{_LOW}'), {_quoted(licenses.COPYRIGHT_LINE)}, '\\1', 'g')"
    out = f"regexp_replace({out}, {_quoted(licenses.NO_WORD)}, ' ', 'g')"
    one = "CASE w " + " ".join(f"WHEN '{old}' THEN '{new}'" for old, new in SPELLINGS if " " not in old) + " ELSE w END"
    line = f"'  ' || array_to_string(list_transform(list_filter(string_split(x, ' '), lambda w: w <> ''), lambda w: {one}), '  ') || '  '"
    for old, new in (pair for pair in SPELLINGS if " " in pair[0]):
        line = f"replace({line}, ' {old.replace(' ', '  ')} ', ' {new.replace(' ', '  ')} ')"
    return f"list_filter(list_transform(string_split({out}, chr(10)), lambda x: trim(replace({line}, '  ', ' '))), lambda x: x <> '')"


def license_scan_sql() -> str:
    known = ", ".join(f"({_quoted(i)}, {_quoted(t)})" for i, t in KNOWN)
    return f"""
WITH known AS (SELECT md5(array_to_string({_canonical("text")}, ' ')) AS digest, min(license_id) AS license_id FROM (VALUES {known}) AS t(license_id, text) GROUP BY 1),
docs AS (SELECT row_number() OVER () AS r, doc_id, {_canonical("text")} AS lines FROM documents),
notices AS (SELECT r, count(*) AS n, array_to_string(list_sort(list_distinct(list(license_id))), ',') AS names
  FROM (SELECT r, md5(unnest(lines)) AS digest FROM docs) JOIN known USING (digest) GROUP BY r)
SELECT doc_id, md5(array_to_string(lines, ' ')) AS digest, license_id, CAST(coalesce(n, 0) AS BIGINT) AS n_license_lines, coalesce(names, '') AS line_licenses
FROM docs LEFT JOIN known ON known.digest = md5(array_to_string(lines, ' ')) LEFT JOIN notices USING (r)"""


def contamination_sql() -> str:
    low = lambda c: f"translate({c}, '{_UP}', '{_LOW}')"
    d = decontam
    return f"""
WITH bench AS (SELECT item_id, {words(low("text"))} AS w FROM benchmark WHERE text IS NOT NULL),
items AS (SELECT item_id, unnest(w) AS w, generate_subscripts(w, 1) AS p, CASE WHEN len(w) < {d.REGION} THEN len(w) ELSE {d.NEED} END AS need FROM bench WHERE len(w) >= {d.LEAST}),
docs AS (SELECT row_number() OVER () AS r, doc_id, {words(low("coalesce(text, '')"))} AS w FROM documents),
toks AS (SELECT r, unnest(w) AS w, generate_subscripts(w, 1) AS p FROM docs),
same AS (SELECT r, item_id, need, toks.p - items.p AS shift, items.p AS p FROM toks JOIN items USING (w)),
seen AS (SELECT r, item_id, need, count(*) OVER (PARTITION BY r, item_id, shift ORDER BY p RANGE BETWEEN CURRENT ROW AND {d.REGION - 1} FOLLOWING) AS n FROM same),
hits AS (SELECT r, count(DISTINCT item_id) AS n_items, min(item_id) AS first_item FROM seen WHERE n >= need GROUP BY r)
SELECT doc_id, hits.r IS NOT NULL AS contaminated, CAST(coalesce(n_items, 0) AS INTEGER) AS n_items, first_item FROM docs LEFT JOIN hits USING (r)"""


def near_duplicates_sql() -> str:
    low = f"translate(coalesce(text, ''), '{_UP}', '{_LOW}')"
    k, percent = neardup.SHINGLE, neardup.PERCENT
    return f"""
WITH RECURSIVE docs AS (SELECT doc_id, {words(low)} AS w FROM documents),
sh AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + {k - 1}], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - {k - 2})) AS i FROM docs WHERE len(w) >= {k})
  UNION ALL SELECT doc_id, array_to_string(w, ' ') FROM docs WHERE len(w) BETWEEN 1 AND {k - 1}),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS MATERIALIZED (SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= {percent} * (x.n + y.n - c)),
reach AS (SELECT a AS d, a AS r FROM links UNION SELECT reach.d, links.b FROM reach JOIN links ON links.a = reach.r)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(c.m, d.doc_id) AS component_id, coalesce(c.m, d.doc_id) = d.doc_id AS kept
FROM docs d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT d AS doc_id, min(r) AS m FROM reach GROUP BY d) c USING (doc_id)"""


def mixing_sql(mix: Mix | None = None) -> str:
    mix = mix or Mix()

    def weight(level: str) -> str:
        own = getattr(mix, level)
        return "CASE " + " ".join(f"WHEN {level} = {_quoted(k)} THEN {v}" for k, v in own.items()) + f" ELSE {mix.other} END" if own else str(mix.other)

    def level(depth: int) -> str:
        keys, parent, name = ", ".join(LEVELS[:depth]), ", ".join(LEVELS[: depth - 1]), LEVELS[depth - 1]
        part = f"PARTITION BY {parent} " if parent else ""
        source = f"(SELECT {keys}, sum(cap) AS cap FROM leaves GROUP BY ALL)"
        given = f"(SELECT CAST(sum(tokens) AS HUGEINT) * {mix.percent} // 100 FROM leaves) AS given FROM {source}" if depth == 1 else f"b.budget AS given FROM {source} JOIN (SELECT {parent}, budget FROM b{depth - 1}) b USING ({parent})"
        return f"""
w{depth} AS (SELECT {keys}, cap, CAST({weight(name)} AS HUGEINT) AS w, {given}),
o{depth} AS (SELECT *, coalesce(sum(cap) OVER ({part}ORDER BY cap::DOUBLE / w::DOUBLE, {name} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cb, sum(w) OVER ({part}ORDER BY cap::DOUBLE / w::DOUBLE, {name} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS wa FROM w{depth}),
f{depth} AS (SELECT *, cap * wa <= (given - cb) * w AS filled FROM o{depth}),
l{depth} AS (SELECT *, given - sum(CASE WHEN filled THEN cap ELSE 0 END) OVER ({part}) AS rest, sum(CASE WHEN filled THEN 0 ELSE w END) OVER ({part}) AS wo, sum(CASE WHEN filled THEN 0 ELSE w END) OVER ({part}ORDER BY cap::DOUBLE / w::DOUBLE, {name} ROWS UNBOUNDED PRECEDING) AS wu FROM f{depth}),
b{depth} AS (SELECT {keys}, CASE WHEN filled THEN cap ELSE rest * wu // wo - rest * (wu - w) // wo END AS budget FROM l{depth})"""

    return f"""
WITH docs AS (SELECT doc_id, text, coalesce(lang, '') AS lang, coalesce(source, '') AS source, CAST(len({words("coalesce(text, '')")}) AS HUGEINT) AS n FROM documents),
named AS (SELECT *, CASE WHEN regexp_extract(source, '([0-9]{{1,9}})$', 1) = '' THEN 'other' ELSE 'd' || (CAST(regexp_extract(source, '([0-9]{{1,9}})$', 1) AS INTEGER) % 4) END AS domain FROM docs WHERE n > 0),
leaves AS (SELECT domain, lang, source, sum(n) AS tokens, sum(n) * {mix.epochs} AS cap FROM named GROUP BY ALL),
{level(1)}, {level(2)}, {level(3)},
placed AS (SELECT named.*, budget // tokens AS whole, budget % tokens AS rest FROM named JOIN leaves USING (domain, lang, source) JOIN b3 USING (domain, lang, source)),
ordered AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY domain, lang, source ORDER BY md5(concat_ws('-', '{mix.seed}', CAST(whole AS VARCHAR), coalesce(CAST(doc_id AS VARCHAR), ''))), doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM placed),
turns AS (SELECT *, unnest(range(0, CAST(whole AS BIGINT) + 1)) AS epoch FROM ordered),
taken AS (SELECT *, CASE WHEN epoch < whole THEN n ELSE least(n, greatest(0, rest - start)) END AS take FROM turns)
SELECT doc_id, domain, lang, source, CAST(epoch AS INTEGER) AS epoch, CAST(n AS BIGINT) AS n_tokens, CAST(take AS BIGINT) AS take_tokens FROM taken WHERE take > 0"""


#: The 256 remainders of CRC-32, by its rule.
CRC_TABLE = "crc_table AS (SELECT list_transform(range(256), lambda n: list_reduce(range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n)) AS remainders)"


def crc32(octets: str) -> str:
    """CRC-32 of a list of bytes, next to ``crc_table``."""
    return f"xor(list_reduce({octets}, lambda c, b: xor(c >> 8, remainders[(xor(c, b) & 255) + 1]), 4294967295::BIGINT), 4294967295::BIGINT)"


def leaderboard_sql() -> str:
    """Every item's revenue after each of its days, every board after each day of its nation, and each board against the one before."""
    b = leaderboard
    batch = f"least({b.BATCHES}, greatest(1, 1 + floor((a - {b.FIRST_DAY}) * {b.BATCHES} / {b.DAYS})))::INTEGER"
    key = " || ',' || ".join(f"coalesce({c}::VARCHAR, '')" for c in ("sale_id", "item_id", "vendor_id", "line_no"))
    at = "from_day <= {0} AND (to_day IS NULL OR {0} < to_day)"
    return f"""
WITH {CRC_TABLE}, hashed AS (SELECT sale_lines.*, {crc32(f"list_transform(string_split({key}, ''), lambda x: ascii(x)::BIGINT)")} AS h FROM sale_lines, crc_table),
dated AS (SELECT *, coalesce(CAST(shipped_at AS DATE) - DATE '1970-01-01', {b.FIRST_DAY} + h % 150) AS s FROM hashed),
arrived AS (SELECT *, s + h % 7 + CASE WHEN h % 5 = 0 THEN 20 ELSE 0 END AS a FROM dated),
cut AS (SELECT *, {batch} AS batch FROM arrived),
seen AS (SELECT batch, max(max(s)) OVER (ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS s_before FROM cut GROUP BY batch),
prices AS (SELECT item_id, min(floor(100 * price + 0.5)) AS price FROM items GROUP BY item_id),
homes AS (SELECT vendor_id, min(nation_id) AS nation_id FROM vendors GROUP BY vendor_id),
counted AS (SELECT nation_id, item_id, a, sum(coalesce(floor(100 * amount + 0.5), quantity * price, 0) * CASE WHEN flag = 'swapped' THEN -1 ELSE 1 END)::BIGINT AS cents
  FROM cut JOIN seen USING (batch) JOIN prices USING (item_id) JOIN homes USING (vendor_id) WHERE nation_id IS NOT NULL AND s + {b.LATE} >= coalesce(s_before, s) GROUP BY ALL),
days AS (SELECT nation_id, a, lag(a) OVER (PARTITION BY nation_id ORDER BY a) AS before FROM (SELECT DISTINCT nation_id, a FROM counted)),
spans AS (SELECT nation_id, item_id, a AS from_day, sum(cents) OVER (PARTITION BY nation_id, item_id ORDER BY a) AS revenue, lead(a) OVER (PARTITION BY nation_id, item_id ORDER BY a) AS to_day FROM counted),
held AS (SELECT nation_id, days.a, item_id, revenue FROM days JOIN spans USING (nation_id) WHERE {at.format("days.a")}),
boards AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY nation_id, a ORDER BY revenue DESC, item_id) AS rank FROM held WHERE revenue > 0) WHERE rank <= {b.TOP}),
earlier AS (SELECT boards.nation_id, days.a, item_id, rank FROM boards JOIN days ON days.nation_id = boards.nation_id AND days.before = boards.a),
diff AS (SELECT coalesce(n.nation_id, o.nation_id) AS nation_id, coalesce(n.a, o.a) AS a, coalesce(n.item_id, o.item_id) AS item_id, o.rank AS old_rank, n.rank AS new_rank
  FROM boards n FULL JOIN earlier o ON o.nation_id = n.nation_id AND o.a = n.a AND o.item_id = n.item_id WHERE o.rank IS DISTINCT FROM n.rank)
SELECT nation_id::INTEGER AS nation_id, a::BIGINT AS arrival_day, item_id, {batch} AS batch, CASE WHEN old_rank IS NULL THEN 'enter' WHEN new_rank IS NULL THEN 'exit' ELSE 'move' END AS change,
  old_rank::INTEGER AS old_rank, new_rank::INTEGER AS new_rank, revenue::BIGINT AS revenue FROM diff JOIN spans USING (nation_id, item_id) WHERE {at.format("a")}"""


def importance_sql() -> str:
    """Words as strings, the CRC of each different one byte by byte."""
    i = importance
    octets = "list_transform(range(octet_length(encode(w))), lambda k: ('0x' || substr(hex(encode(w)), 2 * k + 1, 2))::BIGINT)"
    counted = lambda name, table: f"{name} AS (SELECT bucket, count(*) AS n FROM (SELECT unnest(w) AS w FROM {table}) JOIN hashed USING (w) GROUP BY bucket)"
    split = lambda table: rf"regexp_extract_all(translate(coalesce(text, ''), '{_UP}', '{_LOW}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM {table}"
    return f"""
WITH {CRC_TABLE}, own AS (SELECT row_number() OVER () AS r, doc_id, {split("documents")}), aim AS (SELECT {split("benchmark")}),
hashed AS (SELECT w, {crc32(octets)} % {i.BUCKETS} AS bucket FROM (SELECT unnest(w) AS w FROM own UNION SELECT unnest(w) FROM aim), crc_table),
{counted("s", "own")}, {counted("t", "aim")}, sums AS (SELECT (SELECT coalesce(sum(n), 0) FROM s)::DOUBLE AS s, (SELECT coalesce(sum(n), 0) FROM t)::DOUBLE AS t),
gains AS (SELECT k AS bucket, floor(1000 * ln((coalesce(t.n, 0) + 1) * (sums.s + {i.BUCKETS}) / ((coalesce(s.n, 0) + 1) * (sums.t + {i.BUCKETS})))) AS gain
  FROM range({i.BUCKETS}) AS b(k) LEFT JOIN s ON s.bucket = k LEFT JOIN t ON t.bucket = k CROSS JOIN sums),
means AS (SELECT r, floor(sum(gain) / count(*)) AS weight FROM (SELECT r, unnest(w) AS w FROM own) JOIN hashed USING (w) JOIN gains USING (bucket) GROUP BY r),
scored AS (SELECT r, doc_id, len(w) AS n, coalesce(weight, 0)::BIGINT AS weight,
  coalesce(weight, 0)::BIGINT + floor(-1000 * ln(-ln((('0x' || left(sha256('{i.SEED}:' || coalesce(doc_id::VARCHAR, '')), 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM own LEFT JOIN means USING (r)),
ranked AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS fit FROM scored WHERE n >= {i.LEAST_WORDS})
SELECT doc_id, n::BIGINT AS n_words, n::BIGINT AS n_features, weight, score, CASE WHEN rank <= {i.PERCENT} * fit // 100 THEN rank END::BIGINT AS rank FROM scored LEFT JOIN ranked USING (r)"""
