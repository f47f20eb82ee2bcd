"""SQL for edit distances of lists and for the queries that rest on them: one list fold per row of the table."""

from __future__ import annotations


def _table(a: str, b: str, across: str, start: str) -> str:
    """Last row of the edit table of the number lists `a` (down) and `b` (across), the first row given.

    A row is made as a whole: steps down and aslant first, then those across as a running minimum of the
    entries less their place, in passes over distances 1, 2, 4 and so on. `across` is the first entry of a row.
    """
    here = f"CASE WHEN k = 1 THEN {across} ELSE least(x + 1, row[k - 1] + CASE WHEN c[1] = {b}[k - 1] THEN 0 ELSE 1 END) END - k"

    value = f"list_transform(row, lambda x, k: {here})"
    for n in range(20):
        near = f"list_transform(v{n}, lambda x, k: least(x, CASE WHEN k > {1 << n} THEN v{n}[k - {1 << n}] ELSE x END))"
        value = f"list_transform([{value}], lambda v{n}: CASE WHEN len(v{n}) > {1 << n} THEN {near} ELSE v{n} END)[1]"
    return f"list_reduce(list_transform({a}, lambda x: [x]), lambda row, c: list_transform({value}, lambda x, k: x + k), {start})"


def letters(text: str) -> str:
    """A text as the numbers of its letters."""
    return f"list_transform(string_split({text}, ''), lambda x: unicode(x)::BIGINT)"


def numbers_of(words: str) -> str:
    """A list of words as numbers, equal for equal words."""
    return f"list_transform({words}, lambda x: (hash(x) >> 1)::BIGINT)"


def distance(a: str, b: str) -> str:
    """Edit distance of two number lists."""
    return _table(a, b, "x + 1", f"range(0, len({b}) + 1)") + "[-1]"


def part_distance(a: str, b: str) -> str:
    """Edit distance of number list `a` from the part of `b` that is nearest to it."""
    return f"list_min({_table(a, b, 'x + 1', f'list_transform(range(0, len({b}) + 1), lambda x: 0::BIGINT)')})"


def common_part(a: str, b: str) -> str:
    """[length, end in `a`] of the longest common run of two lists, the first on ties."""
    here = f"list_transform(range(1, len({b}) + 1), lambda j: CASE WHEN {a}[i[1]] = {b}[j] THEN CASE WHEN j > 1 THEN row[j + 1] ELSE 0 END + 1 ELSE 0 END)"
    # row: length and end of the best so far, then the runs that end at each place of b.
    step = f"CASE WHEN list_max(h[1]) > row[1] THEN [list_max(h[1]), i[1]] ELSE row[1:2] END || h[1]"
    fold = f"list_transform([[{here}]], lambda h: {step})[1]"
    return f"list_reduce(list_transform(range(1, len({a}) + 1), lambda x: [x]), lambda row, i: {fold}, [0, 0]::BIGINT[] || list_transform(range(len({b})), lambda x: 0::BIGINT))[1:2]"


TURNS = "SELECT conv_id, turn, text, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS next FROM conversations"
TOKENS = "list_filter(regexp_split_to_array({0}, '\\s+'), lambda x: x <> '')"
#: Of the last 600 characters: the longest end that a piece of 3 to 59 characters repeats three times or more.
LOOP = """coalesce(list_max(list_transform(range(3, least(59, len(t) // 3) + 1), lambda s: list_transform([(len(t) - s - coalesce(list_max(list_filter(range(1, len(t) - s + 1),
   lambda i: t[i] <> t[i + s])), 0)) // s + 1], lambda times: CASE WHEN times >= 3 THEN times * s ELSE 0 END)[1])), 0)::INT"""
LOOPS = f"SELECT doc_id, {LOOP} AS loop FROM (SELECT doc_id, string_split(right(coalesce(text, ''), 600), '') AS t FROM documents)"
#: Letters of the dictionary queries in one byte each, as the engine's distance counts bytes.
PLAIN_LETTERS = "translate({0}, 'àáâãäåæçèéêëìíîïðñòóôõö÷øùúûüýþÿ', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ012345')"
WORDS = "SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-zà-ÿ]+')) AS word FROM {0}"
LEXICON = f"""ws AS ({WORDS.format("conversations")}), lex AS ({WORDS.format("benchmark")}), open AS (SELECT word FROM ws ANTI JOIN lex USING (word))"""
EDIT_ONE = f"""{LEXICON}, near AS (SELECT o.word, l.word AS c FROM (SELECT word, length(word) AS n, {PLAIN_LETTERS.format("word")} AS k FROM open WHERE length(word) BETWEEN 2 AND 20) o
     JOIN (SELECT word, length(word) AS n, {PLAIN_LETTERS.format("word")} AS k FROM lex) l ON abs(o.n - l.n) <= 1 AND (levenshtein(o.k, l.k) <= 1 OR (o.n = l.n AND o.k <> l.k
       AND len(list_filter(range(1, o.n), lambda i: substr(o.k, 1, i - 1) || o.k[i + 1] || o.k[i] || substr(o.k, i + 2) = l.k)) > 0))),
   edit_one AS (SELECT word, arg_min(c, (abs(length(c) - length(word)), length(c), c)) AS fix FROM near GROUP BY word)"""
DOUBLED = """cut AS (SELECT DISTINCT word, substr(word, 1, i - 1) || substr(word, i + 1) AS c FROM (SELECT word, unnest(range(1, length(word))) AS i FROM open WHERE length(word) >= 3) WHERE word[i] = word[i + 1]),
   doubled AS (SELECT cut.word, min(c) AS fix FROM cut JOIN lex ON c = lex.word GROUP BY cut.word HAVING count(*) = 1)"""

SIMILAR = "CASE WHEN greatest(length({0}), length({1})) = 0 THEN 1.0 WHEN least(length({0}), length({1})) = 0 THEN 0.0 ELSE 1 - levenshtein({0}, {1}) / greatest(length({0}), length({1})) END"


def of_documents(fields: str) -> dict[str, str]:
    """Queries over the fields of documents; `fields` is the common part."""
    return {
        "k2_wer_pairs": f"""WITH {fields}, w AS (SELECT doc, field, {numbers_of(TOKENS.format("gt"))} AS a, {numbers_of(TOKENS.format("pred"))} AS b FROM fields WHERE gt <> '' AND pred <> '')
            SELECT doc, field, {distance("a", "b")}::INT AS word_edits, len(a)::INT AS gt_words FROM w""",
    }


def of_conversations(fields: str) -> dict[str, str]:
    """Queries over the fields of conversations: `fields` is the common part."""
    words = f"w AS (SELECT *, {numbers_of('a')} AS na, {numbers_of('b')} AS nb FROM (SELECT *, {TOKENS.format('gt')} AS a, {TOKENS.format('pred')} AS b FROM outcomes))"
    names = "(SELECT unnest(['f000', 'f001', 'f002', 'f003', 'f004', 'f999']) AS field)"
    return {
        "a9_per_field": f"""WITH {fields}, {words}, s AS (SELECT field, outcome, gt, pred, CASE WHEN outcome = 'scored' THEN levenshtein(gt, pred) END AS edits, CASE WHEN outcome = 'scored' THEN length(gt) END AS n,
              CASE WHEN outcome = 'scored' THEN {distance("na", "nb")} END AS we, CASE WHEN outcome = 'scored' THEN len(a) END AS wn FROM w),
            t AS (SELECT field, count(*) FILTER (outcome <> 'unscoreable') AS n, count(*) FILTER (outcome = 'unscoreable') AS unscoreable, round_even(sum(edits) / nullif(sum(n), 0), 4) AS cer,
              round_even(sum(we) / nullif(sum(wn), 0), 4) AS wer, count(*) FILTER (outcome = 'scored' AND gt = pred) AS exact, count(*) FILTER (outcome = 'omission') AS omissions FROM s GROUP BY field)
            SELECT field, coalesce(n, 0) AS n, coalesce(unscoreable, 0) AS unscoreable, cer, wer, coalesce(exact, 0) AS exact, coalesce(omissions, 0) AS omissions FROM {names} LEFT JOIN t USING (field)""",
        "a4_oracle_assign": f"""WITH RECURSIVE {fields}, s AS (SELECT doc, field, has_gt, coalesce(gt, '') AS gt, coalesce(pred, '') AS pred, CASE WHEN has_gt THEN length(trim(coalesce(gt, ''))) ELSE 0 END AS n,
              CASE WHEN outcome = 'scored' THEN levenshtein(gt, pred) END AS edits FROM outcomes),
            g AS (SELECT doc, gt, n, row_number() OVER (PARTITION BY doc ORDER BY field) AS i, count(*) OVER (PARTITION BY doc) AS last FROM s WHERE n > 0),
            p AS (SELECT doc, pred, row_number() OVER (PARTITION BY doc ORDER BY field) - 1 AS j FROM s WHERE trim(pred) <> ''),
            walk AS (SELECT DISTINCT doc, 0::BIGINT AS i, 0::BIGINT AS used, 0::BIGINT AS cost FROM g
                     UNION ALL SELECT doc, i, used, min(cost) FROM (
                       SELECT w.doc, g.i, w.used, w.cost + g.n AS cost FROM walk w JOIN g ON g.doc = w.doc AND g.i = w.i + 1
                       UNION ALL SELECT w.doc, g.i, w.used + (1::BIGINT << p.j), w.cost + levenshtein(g.gt, p.pred) FROM walk w JOIN g ON g.doc = w.doc AND g.i = w.i + 1
                         JOIN p ON p.doc = w.doc WHERE (w.used >> p.j) & 1 = 0) GROUP BY doc, i, used),
            o AS (SELECT w.doc, min(cost) AS oracle_edits FROM walk w JOIN (SELECT doc, max(i) AS i FROM g GROUP BY doc) m ON w.doc = m.doc AND w.i = m.i GROUP BY w.doc),
            a AS (SELECT doc, sum(coalesce(edits, n))::BIGINT AS assigned_edits FROM s GROUP BY doc)
            SELECT doc, oracle_edits, assigned_edits FROM o JOIN a USING (doc)""",
        "a11_reversal": f"""WITH {fields}, {words}, t AS (SELECT b, unnest(a) AS token FROM w WHERE outcome = 'scored'),
            m AS (SELECT token, list_transform(b, lambda p, i: {{'sim': {SIMILAR.format("token", "p")}, 'at': -i, 'word': p}}) AS found FROM t WHERE regexp_matches(token, '[A-Za-z0-9]') AND NOT list_contains(b, token)),
            r AS (SELECT token, list_max(found).sim AS sim, list_max(found).word AS word FROM m)
            SELECT CASE WHEN coalesce(sim, 0) < 0.4 THEN 'absent' WHEN word = reverse(token) THEN 'exact_reversal' WHEN list_sort(string_split(word, '')) = list_sort(string_split(token, '')) THEN 'any_permutation'
              WHEN len(list_filter(['INV-', 'EMP-', 'REF-', 'DOC-', 'NO-'], lambda x: starts_with(token, x) AND word = substr(token, length(x) + 1))) > 0 THEN 'prefix_stripped' ELSE 'genuine_misread' END AS bucket,
              count(*) AS n FROM r GROUP BY 1""",
        "a28_placement": f"""WITH {fields}, c AS (SELECT doc, {letters("string_agg(pred, ' ' ORDER BY field)")} AS content FROM fields GROUP BY doc),
            b AS (SELECT field, length(gt) AS n, levenshtein(gt, coalesce(pred, '')) AS named, {part_distance("g", "content")} AS free FROM (SELECT *, {letters('gt')} AS g FROM fields WHERE has_gt AND gt <> '') JOIN c USING (doc))
            SELECT field, round_even(sum(named) / sum(n), 4) AS named_cer, round_even(sum(free) / sum(n), 4) AS content_cer, round_even((sum(named) - sum(free)) / sum(n), 4) AS assignment_loss,
              round_even(count(*) FILTER (named <= n * 0.5) / count(*), 4) AS placed FROM b GROUP BY field""",
    }


def of_turns(atoms: str) -> dict[str, str]:
    """Queries over neighbouring turns; `atoms` gives the digit groups of `text`."""
    lines = f"""t AS ({TURNS}), p AS (SELECT conv_id * 1000 + turn AS page, next AS page_text, string_split(text, chr(10)) AS ls FROM t WHERE next IS NOT NULL),
        l AS (SELECT page, page_text, unnest(range(len(ls))) AS i, unnest(ls) AS line FROM p),
        e AS (SELECT page, page_text, i, line, {part_distance("a", "b")} AS edits FROM (SELECT *, {letters('line')} AS a, {letters('page_text')} AS b FROM l WHERE line <> ''))"""
    items = lambda source, name, what: (
        f"{name} AS (SELECT page, item, count(*) AS n FROM (SELECT page, unnest({what}) AS item FROM (SELECT page, {source}) ) GROUP BY ALL)"
    )
    numbers = "list_transform(list_filter(regexp_extract_all(text, '\\d+(?:[.,/:\\-]\\d+)*'), lambda x: length(regexp_replace(x, '\\D', '', 'g')) >= 2), lambda x: array_to_string(list_sort(regexp_split_to_array(x, '[.,/:\\-]')), '|'))"
    kept, page = "line AS text FROM k", "page_text AS text FROM p"
    hits = lambda a, b: f"(SELECT sum({a}.n) FROM {a}), (SELECT sum(least({a}.n, {b}.n)) FROM {a} JOIN {b} USING (page, item))"
    return {
        "k3_semiglobal": f"SELECT conv_id, turn, {part_distance('a', 'b')}::INT AS edits, length(text)::INT AS n FROM (SELECT *, {letters('text')} AS a, {letters('next')} AS b FROM ({TURNS}) WHERE next IS NOT NULL)",
        "k4_unsupported_lines": f"WITH {lines} SELECT page, printf('f%03d', i) AS line, line AS text, edits::INT AS edits FROM e WHERE trim(line) <> '' AND edits > length(line) * 0.5",
        "k6_common_substring": f"""SELECT conv_id, turn, substr(text, (m[2] - m[1] + 1)::INT, m[1]::INT) AS common FROM (SELECT *, {common_part("a", "b")} AS m
            FROM (SELECT *, string_split(text, '') AS a, string_split(next, '') AS b FROM ({TURNS}) WHERE next IS NOT NULL))""",
        "a20_coverage": f"""WITH {lines}, k AS (SELECT * FROM e WHERE NOT EXISTS (SELECT 1 FROM e o WHERE o.page = e.page AND o.i <> e.i AND length(e.line) < length(o.line) AND contains(replace(o.line, ' ', ''), replace(e.line, ' ', '')))),
            {items(kept, "ga", atoms)}, {items(page, "pa", atoms)}, {items(kept, "gn", numbers)}, {items(page, "pn", numbers)},
            s AS (SELECT sum(edits) AS err, sum(length(line)) AS chars FROM e), z AS (SELECT sum(length(line)) AS gt_len FROM k),
            q AS (SELECT count(*) AS n, sum(length(page_text)) AS pred_len FROM p WHERE page IN (SELECT page FROM e))
            SELECT q.n, round_even(err / greatest(chars, 1), 4) AS coverage_cer, round_even(coalesce(ah, 0) / greatest(coalesce(an, 0), 1), 4) AS atom_recall, round_even(coalesce(nh, 0) / greatest(coalesce(nn, 0), 1), 4) AS number_exact_recall,
              round_even(pred_len / greatest(gt_len, 1), 3) AS len_ratio
            FROM s, z, q, (SELECT {hits("ga", "pa")}) x(an, ah), (SELECT {hits("gn", "pn")}) y(nn, nh)""",
        "k5_run_class": f"""WITH d AS (SELECT doc_id, regexp_replace(text, '\\D', '', 'g') AS digits, unnest(list_distinct({atoms})) AS atom FROM documents), u AS (SELECT digits, reverse(atom) AS unit, length(atom) AS n FROM d)
            SELECT CASE WHEN contains(digits, unit) THEN 'exact' WHEN contains(digits, reverse(unit)) THEN 'reversed'
              WHEN length(digits) >= n AND len(list_filter(range(1, length(digits) - n + 2), lambda i: list_sort(string_split(substr(digits, i, n), '')) = list_sort(string_split(unit, '')))) > 0 THEN 'permuted'
              WHEN n >= 3 AND len(list_filter(range(1, n - 1), lambda i: contains(digits, substr(unit, i, 3)))) > 0 THEN 'partial' ELSE 'misread' END AS class, count(*) AS n FROM u GROUP BY 1""",
    }


OTHER = {
    "w3_phrase_loop": f"SELECT doc_id, loop FROM ({LOOPS}) WHERE loop >= 60",
    "a19_reliability": f"""WITH chars AS (SELECT doc_id, unnest(range(length(text))) AS pos, unnest(string_split(text, '')) AS c FROM documents),
        islands AS (SELECT doc_id, c, pos - row_number() OVER (PARTITION BY doc_id, c ORDER BY pos) AS g FROM chars),
        runs AS (SELECT doc_id, max(run) AS run FROM (SELECT doc_id, count(*) AS run FROM islands GROUP BY doc_id, c, g) GROUP BY doc_id),
        r AS (SELECT source, coalesce(quality, 1) = 1 AS usable, coalesce(run, 0) AS run, loop FROM documents LEFT JOIN labels USING (doc_id) LEFT JOIN runs USING (doc_id) JOIN ({LOOPS}) USING (doc_id))
        SELECT source, count(*) AS n, round_even(count(*) FILTER (usable) / count(*), 4) AS usable_rate, count(*) FILTER (run >= 20) AS degenerate_runs, count(*) FILTER (run < 20 AND loop >= 60) AS phrase_loops FROM r GROUP BY source""",
    "c1_edit_one": f"WITH {EDIT_ONE} SELECT word, fix FROM edit_one",
    "a26_arms": f"""WITH {EDIT_ONE}, {DOUBLED}, arms AS (SELECT word, fix, 'edit one' AS arm FROM edit_one UNION ALL SELECT word, fix, 'doubled' FROM doubled),
        t AS (SELECT conv_id, turn, regexp_extract_all(lower(text), '[a-zà-ÿ]+') AS ws FROM conversations), r AS (SELECT ws, lead(ws) OVER (PARTITION BY conv_id ORDER BY turn) AS ref FROM t),
        c AS (SELECT arm, list_contains(ref, word) AS had, list_contains(ref, fix) AS has FROM (SELECT ref, unnest(ws) AS word FROM r WHERE ref IS NOT NULL) JOIN arms USING (word))
        SELECT arm, count(*) AS changed, count(*) FILTER (has AND NOT had) AS helpful, count(*) FILTER (had AND NOT has) AS harmful, count(*) FILTER (had = has) AS neutral FROM c GROUP BY arm""",
}
