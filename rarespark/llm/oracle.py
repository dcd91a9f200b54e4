"""SQL forms of the queries that SQL can express, written independently of the operators."""

from __future__ import annotations

from .warc import BASE32

WORDS = r"len(regexp_extract_all({}, '[^\x20\x09-\x0D]+'))"


def base32_sha1(text: str) -> str:
    digits = "||".join(
        f"substr('{BASE32}', 1 + ((('0x' || substr(sha1({text}), {5 * i + 1}, 5))::INTEGER >> {s}) & 31), 1)"
        for i in range(8) for s in (15, 10, 5, 0))
    return f"({digits})"


def warc() -> str:
    return f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
     g AS (SELECT html, max(page_id) AS latest FROM p GROUP BY html)
SELECT p.page_id, CAST(octet_length(encode(p.html)) AS BIGINT) AS payload_bytes, {base32_sha1("p.html")} AS payload_digest,
       CASE WHEN p.page_id IS NOT DISTINCT FROM g.latest THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN p.page_id IS DISTINCT FROM g.latest THEN g.latest END AS refers_to
FROM p JOIN g ON p.html = g.html"""


def units(min_words: int) -> str:
    """Every run spelled out; what is covered by a later one of equal content goes."""
    unit = r"'(?:[^\n.!?]+|[.!?]+[^\x20\x09-\x0D.!?])*(?:[.!?]*[\x20\x09-\x0D]+|[.!?]+|\z)'"
    plain = r"trim(regexp_replace(lower(unit), '[\x20\x09-\x0D]+', ' ', 'g'))"
    return f"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, text FROM (SELECT DISTINCT doc_id, coalesce(text, '') AS text FROM documents)),
     u AS (SELECT k, unnest(list) AS unit, generate_subscripts(list, 1) AS i
           FROM (SELECT k, list_filter(regexp_extract_all(text, {unit}), lambda x: x <> '') AS list FROM d)),
     o AS (SELECT *, {plain} AS plain, {WORDS.format('unit')} AS n, sum({WORDS.format('unit')}) OVER w AS upto, sum(length(unit)) OVER w - length(unit) AS start
           FROM u WINDOW w AS (PARTITION BY k ORDER BY i)),
     e AS (SELECT s.k, s.i, min(t.i) AS j FROM o s JOIN o t ON s.k = t.k AND t.i >= s.i AND t.upto >= s.upto - s.n + {min_words} WHERE s.n > 0 GROUP BY s.k, s.i),
     c AS (SELECT e.k, e.i, e.j, string_agg(plain, ' ' ORDER BY o.i) FILTER (plain <> '') AS content
           FROM e JOIN o ON o.k = e.k AND o.i BETWEEN e.i AND e.j GROUP BY e.k, e.i, e.j),
     x AS (SELECT c.*, row_number() OVER (PARTITION BY content ORDER BY doc_id NULLS LAST, md5(text), i) > 1 AS later FROM c JOIN d USING (k)),
     m AS (SELECT o.*, EXISTS (SELECT 1 FROM x WHERE x.k = o.k AND later AND o.i BETWEEN x.i AND x.j) AS gone FROM o),
     g AS (SELECT *, i - row_number() OVER (PARTITION BY k, gone ORDER BY i) AS island FROM m),
     s AS (SELECT k, min(start) AS first, max(start + length(unit)) AS last FROM g WHERE gone GROUP BY k, island),
     l AS (SELECT k, string_agg(CAST(first AS BIGINT) || ':' || CAST(last AS BIGINT), ' ' ORDER BY first) AS spans FROM s GROUP BY k),
     r AS (SELECT k, count(*) FILTER (gone) AS n_removed, string_agg(unit, '' ORDER BY i) FILTER (NOT gone) AS kept FROM g GROUP BY k)
SELECT d.doc_id, coalesce(n_removed, 0) AS n_removed, coalesce(spans, '') AS removed_spans, coalesce(kept, '') AS kept_text
FROM documents x JOIN d ON x.doc_id IS NOT DISTINCT FROM d.doc_id AND coalesce(x.text, '') = d.text LEFT JOIN r USING (k) LEFT JOIN l USING (k)"""


def vectors() -> str:
    """All pairs of a label in double precision, and reachability by recursion."""
    return """
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
     g AS (SELECT * FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
           AND len(list_filter(e, lambda x: x <> 0)) > 0),
     l AS (SELECT a.vec_id AS x, b.vec_id AS y FROM g a JOIN g b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
           AND list_cosine_similarity(a.e, b.e) >= 0.93),
     r AS (SELECT vec_id AS x, vec_id AS y FROM v UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x),
     c AS (SELECT x, min(y) AS component_id FROM r GROUP BY x),
     n AS (SELECT x, count(*) AS n_links FROM l GROUP BY x)
SELECT vec_id, CAST(coalesce(n_links, 0) AS BIGINT) AS n_links, component_id, vec_id = component_id AS kept
FROM v JOIN c ON c.x = vec_id LEFT JOIN n ON n.x = vec_id"""


def _seats(name: str, of: str, group: str, weight: str, seats: str, order: str) -> str:
    """Sainte-Lague by listing every quotient and taking the highest."""
    return f"""
{name}_q AS (SELECT *, CAST({weight} AS DOUBLE) / (2 * seat + 1) AS quotient
    FROM (SELECT *, unnest(range(CAST({seats} AS BIGINT))) AS seat FROM {of}) WHERE {weight} > 0),
{name}_w AS (SELECT *, row_number() OVER ({f'PARTITION BY {group} ' if group else ''}ORDER BY quotient DESC, {order}, seat) <= {seats} AS won FROM {name}_q),
{name} AS (SELECT {group + ', ' if group else ''}{order.split(', ')[-1]} AS party, count(*) FILTER (won) AS quota FROM {name}_w GROUP BY ALL)"""


def mixing(block: int, shard_rows: int, bundle: int, seed: str) -> str:
    return f"""
WITH d AS (SELECT doc_id, source IS NOT NULL AS known, coalesce(source, '') AS name, {WORDS.format("coalesce(text, '')")} AS size,
       md5('{seed}|' || coalesce(CAST(doc_id AS VARCHAR), '')) AS draw FROM documents),
n AS (SELECT greatest(1, CAST(ceil(count(*) / {shard_rows}.0) AS BIGINT)) AS shards, sum(size) AS all_words FROM d),
z AS (SELECT d.*, ('0x' || substr(draw, 1, 12))::BIGINT % n.shards AS shard, (('0x' || substr(draw, 1, 12))::BIGINT % n.shards) // {bundle} AS bundle FROM d, n),
s AS (SELECT known, name, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY known DESC, name) - 1 AS place FROM z GROUP BY known, name),
w AS (SELECT *, CASE place % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight FROM s),
f AS (SELECT a.place, sum(least(2 * b.source_size, 2.0 * a.source_size / a.weight * b.weight)) AS reached FROM w a, w b GROUP BY a.place),
held AS (SELECT w.*, reached <= 1.5 * all_words AS held FROM w JOIN f USING (place), n),
level AS (SELECT (1.5 * (SELECT all_words FROM n) - coalesce(sum(2 * source_size) FILTER (held), 0))::DOUBLE AS words, sum(weight) FILTER (NOT held) AS weights FROM held),
t AS (SELECT held.*, CASE WHEN held THEN 2.0 * source_size ELSE words * weight / weights END::DOUBLE AS target,
      CAST(floor(1.5 * all_words / {block} + 0.5) AS BIGINT) AS seats FROM held, level, n),
{_seats('sq', 't', '', 'target', 'seats', 'place')},
b AS (SELECT t.place, bundle, sum(size)::BIGINT AS bundle_size, any_value(coalesce(sq.quota, 0)) AS seats
      FROM z JOIN t USING (known, name) LEFT JOIN sq ON sq.party = t.place GROUP BY t.place, bundle),
{_seats('bq', 'b', 'place', 'bundle_size', 'seats', 'bundle')},
h AS (SELECT t.place, z.bundle, shard, sum(size)::BIGINT AS shard_size, any_value(coalesce(bq.quota, 0)) AS seats
      FROM z JOIN t USING (known, name) LEFT JOIN bq ON bq.place = t.place AND bq.party = z.bundle GROUP BY t.place, z.bundle, shard),
{_seats('hq', 'h', 'place, bundle', 'shard_size', 'seats', 'shard')},
k0 AS (SELECT h.place, h.bundle, h.shard, shard_size, least(coalesce(hq.quota, 0) * {block}, 2 * shard_size) AS words, least(coalesce(sq.quota, 0) * {block}, 2 * t.source_size) AS source_words
      FROM h JOIN t USING (place) LEFT JOIN sq ON sq.party = h.place LEFT JOIN hq ON hq.place = h.place AND hq.bundle = h.bundle AND hq.party = h.shard),
k1 AS (SELECT place, bundle, sum(2 * shard_size - words) AS room, any_value(source_words) - sum(sum(words)) OVER (PARTITION BY place) AS surplus FROM k0 GROUP BY place, bundle),
k2 AS (SELECT *, greatest(0, least(room, surplus - coalesce(sum(room) OVER (PARTITION BY place ORDER BY bundle ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS extra FROM k1),
k AS (SELECT place, shard, shard_size, words + greatest(0, least(2 * shard_size - words, extra - coalesce(sum(2 * shard_size - words) OVER (
        PARTITION BY place, bundle ORDER BY shard ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS words FROM k0 JOIN k2 USING (place, bundle)),
c AS (SELECT z.*, t.place, t.source_size, t.target,
      coalesce(sum(size) OVER (PARTITION BY known, name, shard ORDER BY draw, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
      FROM z JOIN t USING (known, name))
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
       CAST(CASE WHEN shard_size = 0 THEN 0 ELSE (words // shard_size) * size + greatest(0, least(size, words % shard_size - start)) END AS BIGINT) AS taken
FROM c JOIN k USING (place, shard)"""


def crc32(text: str) -> str:
    """The checksum of an ASCII text, bit by bit."""
    bits = f"flatten(list_transform(string_split({text}, ''), lambda ch: list_transform(range(8), lambda i: (ord(ch) >> i) & 1)))"
    return (f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform({bits}, lambda b: b::BIGINT)), lambda crc, bit: "
            f"CASE WHEN xor(crc, bit) & 1 = 1 THEN xor(crc >> 1, 3988292384::BIGINT) ELSE crc >> 1 END), 4294967295::BIGINT)")


def runs() -> str:
    """All pairs of equal words at a lag of at most a quarter of the text, and islands of neighbouring pairs."""
    word = r"'[^\x20\x09-\x0D]+'"
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), {word}) AS given, {crc32("CAST(doc_id AS VARCHAR)")} AS h
           FROM documents),
     e AS (SELECT *, len(given) AS n, h // 10 AS g FROM d),
     f AS (SELECT *, CASE WHEN n > 0 THEN g % n END AS a FROM e),
     k AS (SELECT *, CASE WHEN n > 0 THEN 1 + (n - a) // (3 + g % 8) END AS p FROM f),
     x AS (SELECT rid, doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(n), lambda i: given[CAST(1 + CASE WHEN i < a THEN i ELSE a + (i - a) % p END AS BIGINT)])
           ELSE given END AS words FROM k),
     w AS (SELECT rid, n, unnest(words) AS word, generate_subscripts(words, 1) - 1 AS pos FROM x),
     l AS (SELECT a.rid, a.pos, b.pos - a.pos AS q FROM w a JOIN w b ON a.rid = b.rid AND a.word = b.word AND b.pos > a.pos AND b.pos - a.pos <= a.n // 4),
     i AS (SELECT *, pos - row_number() OVER (PARTITION BY rid, q ORDER BY pos) AS island FROM l),
     c AS (SELECT rid, q, min(pos) AS s, count(*) + q AS size FROM i GROUP BY rid, q, island HAVING count(*) + q >= greatest(6, 4 * q)),
     r AS (SELECT * FROM c WHERE NOT EXISTS (SELECT 1 FROM c b WHERE b.rid = c.rid AND b.q < c.q AND b.s <= c.s AND b.s + b.size >= c.s + c.size)),
     t AS (SELECT rid, count(*) AS n_runs, min((-size, s, q)) AS top, string_agg(s || ',' || size || ',' || q || chr(10), '' ORDER BY s, q) AS listed FROM r GROUP BY rid),
     y AS (SELECT rid, string_agg(word, ' ' ORDER BY pos) AS stays FROM w WHERE NOT EXISTS (
             SELECT 1 FROM r WHERE r.rid = w.rid AND w.pos >= r.s + r.q AND w.pos < r.s + r.size) GROUP BY rid)
SELECT x.doc_id, CAST(coalesce(n_runs, 0) AS BIGINT) AS n_runs, CAST(top[2] AS BIGINT) AS start, CAST(-top[1] AS BIGINT) AS length, CAST(top[3] AS BIGINT) AS period,
       CAST(1000 * -top[1] // top[3] AS BIGINT) AS exponent_milli, sha256(coalesce(listed, '')) AS runs_sha256, sha256(coalesce(stays, '')) AS collapsed_sha256
FROM x LEFT JOIN t USING (rid) LEFT JOIN y USING (rid)"""


def conversations() -> str:
    """Row by row, the best edits so far for each last letter."""
    key = "coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')"
    solid = r"'[^\x20\x09-\x0D]'"
    follows = "CASE s.q WHEN 2 THEN 3 ELSE 2 END"
    role = "CASE s.q WHEN 2 THEN 'assistant' ELSE 'user' END"
    line = "s.t || CASE WHEN s.q > 0 THEN chr(10) ELSE '' END || "
    insert = f"lambda s: {{'q': {follows}, 'c': s.c + 5, 'a': s.a || 'I', 't': {line}{role} || ':'}}"
    late = "CASE WHEN upper(x.code) = x.code THEN 5 ELSE 0 END"
    keep = ("CASE WHEN lower(x.code) = 's' AND s.q = 0 THEN 1 WHEN lower(x.code) = 'u' AND s.q <> 2 THEN 2 "
            "WHEN lower(x.code) = 'a' AND s.q = 2 THEN 3 ELSE -1 END")
    edit = f"""lambda s: [{{'q': s.q, 'c': s.c + 2, 'a': s.a || 'D', 't': s.t}},
        {{'q': CASE WHEN x.code = '-' THEN -1 ELSE {keep} END, 'c': s.c + {late}, 'a': s.a || 'K', 't': {line}x.role || ':' || x.text}},
        {{'q': CASE WHEN x.code = '-' THEN -1 ELSE {follows} END, 'c': s.c + 1 + {late}, 'a': s.a || 'R', 't': {line}{role} || ':' || x.text}}]"""
    opened = f"list_concat(acc.st, list_concat(list_transform(acc.st, {insert}), list_transform(list_transform(acc.st, {insert}), {insert})))"
    best = "list_filter(list_transform([0, 1, 2, 3], lambda q: list_sort(list_filter(acc2, lambda z: z.q = q))[1]), lambda z: z IS NOT NULL)"
    step = best.replace("acc2", f"flatten(list_transform({opened}, {edit}))")
    kind = "STRUCT(q INTEGER, c INTEGER, a VARCHAR, t VARCHAR)[]"
    item = f"STRUCT(st {kind}, code VARCHAR, \"role\" VARCHAR, \"text\" VARCHAR)"
    return f"""
WITH r AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {crc32(key)} % 20 AS h FROM conversations),
     d AS (SELECT conv_id, turn, CASE h WHEN 4 THEN 'user' ELSE role END AS role, CASE h WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
           unnest(CASE h WHEN 3 THEN [0, 1] ELSE [0] END) AS copy FROM r WHERE h <> 0),
     o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos FROM d),
     f AS (SELECT *, CASE WHEN NOT regexp_matches(text, {solid}) THEN 'b' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 THEN 'd'
             WHEN regexp_extract(text, '(' || {solid} || ')[\\x20\\x09-\\x0D]*$', 1) NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault,
             lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY pos) || left(role, 1) AS pair FROM o),
     v AS (SELECT *, CASE WHEN fault IN ('b', 'd') THEN '-' WHEN fault = 't' THEN upper(l) ELSE l END AS code
           FROM (SELECT *, CASE WHEN left(role, 1) IN ('s', 'u', 'a') THEN left(role, 1) ELSE 'o' END AS l FROM f)),
     g AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank,
             count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated,
             count(*) FILTER (pair IS NOT NULL AND pair NOT IN ('su', 'ua', 'au')) AS illegal,
             list(CAST({{'st': NULL, 'code': code, 'role': role, 'text': text}} AS {item}) ORDER BY pos) AS items FROM v GROUP BY conv_id),
     s AS (SELECT *, list_reduce(list_prepend(CAST({{'st': [{{'q': 0, 'c': 0, 'a': '', 't': ''}}], 'code': '', 'role': '', 'text': ''}} AS {item}), items),
             lambda acc, x: CAST({{'st': {step}, 'code': x.code, 'role': x.role, 'text': x.text}} AS {item})).st AS st FROM g),
     z AS (SELECT *, list_sort(list_transform(list_filter(list_concat(st, list_concat(list_transform(st, {insert}), list_transform(list_transform(st, {insert}), {insert}))),
             lambda s: s.q IN (0, 3)), lambda s: {{'c': s.c, 'a': s.a, 't': s.t}}))[1] AS won FROM s)
SELECT c.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank, CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate,
       CAST(coalesce(truncated, 0) AS BIGINT) AS truncated, CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, CAST(coalesce(won.c, 0) AS BIGINT) AS cost,
       coalesce(won.a, '') AS audit, sha256(coalesce(won.t, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN z ON z.conv_id IS NOT DISTINCT FROM c.conv_id"""
