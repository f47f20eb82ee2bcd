"""SQL that the queries of operators 11 to 13 are checked against."""

#: Unsigned crc32 of a decimal number `{x}`, bit by bit.
CRC32 = """xor(4294967295, list_reduce([4294967295] || list_transform(string_split({x}::varchar, ''), lambda c: ascii(c)::bigint),
    lambda crc, c: list_reduce([xor(crc, c)] || range(8), lambda a, i: xor(a >> 1, 3988292384 * (a & 1)))))"""

_FIELD = "coalesce(strlen({c}::varchar) || ':' || {c}::varchar, '-')"
_LEAF = "sha256(" + " || ".join(_FIELD.format(c=c) for c in ("doc_id", "source", "lang", "n_chars", "{text}")) + ")"

MERKLE = f"""
    WITH RECURSIVE d AS (
        SELECT doc_id, coalesce('.' || source, '') AS g, {_LEAF.format(text="text")} AS leaf,
               CASE WHEN {CRC32.format(x="doc_id")} % 2 = 0 THEN {_LEAF.format(text="replace(text, chr(10), '')")} END AS other FROM documents),
    leaves AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place, count(*) OVER (PARTITION BY g) AS n FROM d),
    tree AS (
        SELECT g, 0 AS level, place, n, leaf AS node FROM leaves
        UNION ALL
        SELECT g, level + 1, place // 3, (n + 2) // 3, sha256(string_agg(node, '' ORDER BY place)) FROM tree WHERE n > 1 GROUP BY g, level, place // 3, n),
    subroots AS (SELECT g, node AS subroot, row_number() OVER (ORDER BY g) - 1 AS place, count(*) OVER () AS n FROM tree WHERE n = 1),
    top AS (
        SELECT 0 AS level, place, n, subroot AS node FROM subroots
        UNION ALL
        SELECT level + 1, place // 3, (n + 2) // 3, sha256(string_agg(node, '' ORDER BY place)) FROM top WHERE n > 1 GROUP BY level, place // 3, n),
    kin AS (
        SELECT g, level, place, list(node) OVER w AS before, list(node) OVER v AS after FROM tree WHERE n > 1
        WINDOW w AS (PARTITION BY g, level, place // 3 ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
               v AS (PARTITION BY g, level, place // 3 ORDER BY place ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)),
    top_kin AS (
        SELECT level, place, list(node) OVER w AS before, list(node) OVER v AS after FROM top WHERE n > 1
        WINDOW w AS (PARTITION BY level, place // 3 ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
               v AS (PARTITION BY level, place // 3 ORDER BY place ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)),
    steps AS (
        SELECT doc_id, leaf, other, g, 0 AS tier, level, before, after FROM leaves JOIN kin USING (g) WHERE kin.place = leaves.place // pow(3, level)::bigint
        UNION ALL
        SELECT doc_id, leaf, other, g, 1, level, before, after FROM leaves JOIN subroots USING (g), top_kin WHERE top_kin.place = subroots.place // pow(3, level)::bigint),
    paths AS (
        SELECT doc_id, leaf, list(coalesce(array_to_string(before, ''), '') || '|' || coalesce(array_to_string(after, ''), '') ORDER BY tier, level) AS path FROM steps GROUP BY doc_id, leaf),
    folded AS (
        SELECT l.doc_id, l.leaf, l.g, coalesce(path, []) AS path, list_reduce([coalesce(l.other, l.leaf)] || coalesce(path, []), lambda node, p: sha256(split_part(p, '|', 1) || node || split_part(p, '|', 2))) AS folded_root
        FROM leaves l LEFT JOIN paths p ON l.leaf = p.leaf AND l.doc_id IS NOT DISTINCT FROM p.doc_id)
    SELECT doc_id, leaf, subroot, root, sha256(replace(array_to_string(path, ''), '|', '')) AS proof_sha256, folded_root, folded_root = root AS verified
    FROM folded JOIN subroots USING (g), (SELECT node AS root FROM top WHERE n = 1)
"""

URL_FILTER = """
    WITH u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
    p AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                 regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
    rules(h, s, v) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
    listed AS (SELECT DISTINCT host AS h FROM p WHERE list_has_any(regexp_split_to_array(host, '[.-]'), ['ads', 'adult', 'bets', 'casino', 'pills', 'spam']))
    SELECT page_id, host, path,
           (SELECT max_by(h || s, (length(h || s), length(h))) FROM rules WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, s)) AS rule,
           coalesce((SELECT max_by(v, (length(h || s), length(h))) FROM rules WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, s)),
                    CASE WHEN EXISTS (SELECT 1 FROM listed WHERE host = h OR ends_with(host, '.' || h)) THEN 'block' ELSE 'allow' END) AS verdict
    FROM p
"""

PREFIX_TRIE = f"""
    WITH t AS (
        SELECT conv_id AS c, dense_rank() OVER (ORDER BY coalesce(role, ''), coalesce(text, '')) AS token, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS n_words,
               row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS i
        FROM conversations WHERE conv_id IS NOT NULL),
    c AS (SELECT c, {CRC32.format(x="c")} % 4 AS h FROM (SELECT DISTINCT c FROM t)),
    built AS (
        SELECT c.c, 0 AS part, i, token, n_words FROM c JOIN t ON t.c = c.c - c.c % 20 AND i <= h
        UNION ALL
        SELECT c.c, 1, i, token, n_words FROM c JOIN t ON t.c = c.c AND i > h),
    path AS (
        SELECT c.c, coalesce(list(token ORDER BY part, i) FILTER (token IS NOT NULL), []) AS k, coalesce(list(n_words ORDER BY part, i) FILTER (token IS NOT NULL), []) AS ws
        FROM c LEFT JOIN built USING (c) GROUP BY c.c),
    prefix AS (SELECT c, k, ws, unnest(range(len(k) + 1)) AS d FROM path),
    node AS (
        SELECT k[1:d] AS k, d, min(c) AS conv_id, count(*) AS n_convs, (count(*) - 1) * coalesce(any_value(ws[d]), 0) AS saved,
               sha256(coalesce(string_agg(c::varchar, ',' ORDER BY c) FILTER (len(k) = d), '')) AS ends_sha256
        FROM prefix GROUP BY k[1:d], d),
    child AS (SELECT k[1:d - 1] AS k, count(*) AS n_children FROM node WHERE d > 0 GROUP BY ALL),
    full_node AS (SELECT node.*, coalesce(n_children, 0) AS n_children FROM node LEFT JOIN child USING (k)),
    under AS (SELECT k[1:e] AS k, count(*) FILTER (n_children = 0) AS n_leaves, sum(saved) AS saved_tokens FROM (SELECT *, unnest(range(d + 1)) AS e FROM full_node) GROUP BY k[1:e])
    SELECT n.conv_id, n.d AS depth, p.conv_id AS parent_conv_id, n.n_convs, n.n_children, n_leaves, saved_tokens, n.ends_sha256
    FROM full_node n JOIN under USING (k) LEFT JOIN node p ON n.d > 0 AND p.k = n.k[1:n.d - 1]
"""
