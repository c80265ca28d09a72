"""SQL twins of the operators that an engine can check by brute force: all pairs of texts, recursive components."""

from __future__ import annotations

from .text import PLACEHOLDERS, TABLE

_QUOTED = lambda s: "'" + s.replace("'", "''") + "'"


def canon(c: str) -> str:
    """One form for strings that look alike: normalised, each look-alike replaced, normalised again; twice."""
    single = {a: b for a, b in TABLE.items() if len(b) == 1}
    gone = "".join(a for a, b in TABLE.items() if not b)
    out = c
    for _ in range(2):
        out = f"translate(nfc_normalize({out}), {_QUOTED(''.join(single) + gone)}, {_QUOTED(''.join(single.values()))})"
        for a, b in TABLE.items():
            if len(b) > 1:
                out = f"replace({out}, {_QUOTED(a)}, {_QUOTED(b)})"
    return f"nfc_normalize({out})"


def texts(select: str, real: bool = False) -> str:
    """CTEs over the distinct strings s of a query: tok (s, c: number of the content), and near (x, y): close contents.

    real leaves out placeholders and texts without a letter.
    """
    split = r"list_filter(string_split_regex(regexp_replace(f, '\[.*?\]', ' ', 'gs'), '[/།༎༏༐༑༔|་\s]+'), lambda t: t <> '')"
    odd = f"AND NOT (len(t) <= 2 AND (array_to_string(t, ' ') IN ({', '.join(map(_QUOTED, sorted(PLACEHOLDERS)))}) OR NOT regexp_matches(array_to_string(t, ''), '\\p{{L}}')))" if real else ""
    return f"""raw AS (SELECT DISTINCT s FROM ({select}) WHERE s IS NOT NULL), forms AS (SELECT s, CASE WHEN s = strip_accents(s) AND regexp_full_match(s, '[ -~\\s]*') THEN s ELSE {canon("s")} END AS f FROM raw),
lists AS (SELECT s, {split} AS t FROM forms), tok AS (SELECT s, t, dense_rank() OVER (ORDER BY array_to_string(t, ' ')) AS c FROM lists WHERE len(t) > 0 {odd}), con AS (SELECT DISTINCT c, t, len(t) AS n FROM tok),
el AS (SELECT c, n, e, row_number() OVER (PARTITION BY c, e) AS nth FROM (SELECT c, n, unnest(t) AS e FROM con)),
near AS (SELECT a.c AS x, b.c AS y FROM el a JOIN el b ON a.e = b.e AND a.nth = b.nth GROUP BY a.c, b.c HAVING 5 * count(*) >= 4 * greatest(max(a.n), max(b.n)))"""


def components(edges: str, node: str) -> str:
    """CTEs after edges (a, b) both ways: root (node, root), the smallest node that each reaches."""
    return f"reach(node, far) AS (SELECT a, a FROM {edges} UNION SELECT r.node, e.b FROM reach r JOIN {edges} e ON r.far = e.a), root AS (SELECT node AS {node}, min(far) AS root FROM reach GROUP BY 1)"


def _repeats(rows: str) -> str:
    """rep (i, j): records of (id, a, b as contents) that repeat one another, in either arrangement."""
    return f"""rep AS (SELECT DISTINCT u.id AS i, v.id AS j FROM {rows} u JOIN near p ON p.x = u.a JOIN near q ON q.x = u.b JOIN {rows} v ON (v.a = p.y AND v.b = q.y) OR (v.a = q.y AND v.b = p.y) WHERE u.id <> v.id)"""


_SPLIT = r"lower(regexp_replace(split_name, '^\s+|\s+$', '', 'g'))"
_SCORED = f"""{texts("SELECT SentenceA s FROM scored_pairs UNION ALL SELECT SentenceB FROM scored_pairs")},
one AS (SELECT ID AS id, min((SentenceA, SentenceB, {_SPLIT}, coalesce(set_source, 'unknown'))) AS r FROM scored_pairs WHERE ID IS NOT NULL GROUP BY ID),
rec AS (SELECT id, x.c AS a, y.c AS b, r[3] AS split, r[4] AS source FROM one JOIN tok x ON x.s = r[1] JOIN tok y ON y.s = r[2]),
{_repeats("rec")}, hits AS (SELECT i, j FROM rep JOIN rec u ON u.id = i JOIN rec v ON v.id = j WHERE u.split IN ('validation', 'test') AND v.split = 'train')"""
P2_FOUND = f"WITH {_SCORED} SELECT least(i, j) AS id_a, greatest(i, j) AS id_b FROM hits"
P2_BY_SPLIT = f"""WITH {_SCORED}, n AS (SELECT i, count(*) AS n FROM hits GROUP BY 1) SELECT split, source, count(*) AS records, count(n) AS leaked, coalesce(sum(n), 0)::BIGINT AS pairs FROM rec LEFT JOIN n ON i = id WHERE split IN ('validation', 'test') GROUP BY 1, 2"""

P1_FOUND = f"""WITH RECURSIVE {texts("SELECT SentenceA s FROM selected_pairs UNION ALL SELECT SentenceB FROM selected_pairs")},
one AS (SELECT ID AS id, arg_min((SentenceA, SentenceB), (arrived_at, SentenceA, SentenceB)) AS r FROM selected_pairs WHERE ID IS NOT NULL GROUP BY ID),
rec AS (SELECT id, x.c AS a, y.c AS b FROM one JOIN tok x ON x.s = r[1] JOIN tok y ON y.s = r[2]), {_repeats("rec")},
nb AS (SELECT id, row_number() OVER (ORDER BY id) AS k, list(j) FILTER (j < id) AS before FROM rec LEFT JOIN rep ON i = id GROUP BY id),
st(k, acc) AS (SELECT 0::BIGINT, []::VARCHAR[] UNION ALL SELECT st.k + 1, CASE WHEN n.before IS NOT NULL AND list_has_any(n.before, st.acc) THEN st.acc ELSE list_append(st.acc, n.id) END FROM st JOIN nb n ON n.k = st.k + 1),
ok AS (SELECT unnest(acc) AS id FROM (SELECT acc FROM st ORDER BY k DESC LIMIT 1)) SELECT j AS id_first, i AS id_again FROM rep WHERE j < i AND j IN (SELECT id FROM ok) AND i NOT IN (SELECT id FROM ok)"""

_VECTORS = "(SELECT DISTINCT vec_id, embeddings::DOUBLE[] AS v FROM sentence_vectors WHERE vec_id IS NOT NULL AND len(embeddings) = 96 AND NOT list_bool_or(list_transform(embeddings, lambda x: isnan(x) OR isinf(x) OR x IS NULL)) AND list_sum(list_transform(embeddings, lambda x: abs(x))) > 0)"
_UNIT = f"(SELECT vec_id, list_transform(v, lambda x: x / l)::DOUBLE[96] AS u FROM (SELECT vec_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS l FROM {_VECTORS}))"
P4_FOUND = f"""WITH RECURSIVE u AS MATERIALIZED {_UNIT}, e AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id WHERE array_inner_product(a.u, b.u) >= 0.75), {components("e", "vec_id")}
SELECT root AS vec_id_first, vec_id FROM root WHERE vec_id <> root"""

# contents alone; near is not needed
_TRAINSET = texts("SELECT SentenceA s FROM merged_trainset UNION ALL SELECT SentenceB FROM merged_trainset").split(", con AS")[0]
P6_FOUND = f"""WITH RECURSIVE {_TRAINSET},
ids AS (SELECT DISTINCT ID AS id, regexp_extract_all(lower({canon("ID")}), '[0-9]+|\\p{{L}}+') AS f FROM merged_trainset WHERE ID IS NOT NULL),
keys AS (SELECT m.ID AS id, 's' || t.c AS k FROM merged_trainset m JOIN tok t ON t.s = m.SentenceA OR t.s = m.SentenceB WHERE m.ID IS NOT NULL
UNION SELECT id, 'i' || array_to_string(list_transform(list_slice(f, 1, len(f) - 1), lambda x: CASE WHEN regexp_full_match(x, '[0-9]+') THEN coalesce(nullif(ltrim(x, '0'), ''), '0') ELSE x END), '_') FROM ids WHERE len(f) > 1),
e AS MATERIALIZED (SELECT DISTINCT a.id AS a, b.id AS b FROM keys a JOIN keys b ON a.k = b.k AND a.id <> b.id), {components("e", "id")}
SELECT root AS id_first, id AS id_member FROM root WHERE id <> root"""

_SEGMENTS = "SELECT Segmented_Text_EWTS s FROM segments UNION ALL SELECT Segmented_Text FROM segments"
_GROUPS = f"""WITH RECURSIVE {texts(_SEGMENTS, real=True)},
rows AS (SELECT seg_no, 1 AS f, c FROM segments JOIN tok ON s = Segmented_Text_EWTS UNION ALL SELECT seg_no, 2, c FROM segments JOIN tok ON s = Segmented_Text),
firsts AS (SELECT f, c, min(seg_no) AS first FROM rows GROUP BY 1, 2),
e AS MATERIALIZED (SELECT a.first AS a, b.first AS b FROM near JOIN firsts a ON a.c = x JOIN firsts b ON b.c = y AND a.f = b.f WHERE a.first <> b.first UNION SELECT r.seg_no, k.first FROM rows r JOIN firsts k USING (f, c) WHERE r.seg_no <> k.first UNION SELECT k.first, r.seg_no FROM rows r JOIN firsts k USING (f, c) WHERE r.seg_no <> k.first), {components("e", "seg_no")}"""
P7_FOUND = f"{_GROUPS} SELECT root AS seg_no_first, seg_no FROM root WHERE seg_no <> root"
P7_GROUPS = f"{_GROUPS} SELECT seg_no, root AS group_first, count(*) OVER (PARTITION BY root) AS group_size FROM root"

_LOOKS = f"""looks AS (SELECT DISTINCT seg_no, field, s, {canon("s")} AS f FROM (SELECT seg_no, 'Segmented_Text_EWTS' AS field, Segmented_Text_EWTS AS s FROM segments UNION ALL SELECT seg_no, 'Segmented_Text', Segmented_Text FROM segments)
WHERE s IS NOT NULL AND regexp_matches(s, '\\p{{L}}') AND trim(s) NOT IN ({', '.join(map(_QUOTED, sorted(PLACEHOLDERS)))}))"""
P3_FOUND = f"WITH {_LOOKS} SELECT DISTINCT a.seg_no AS seg_no_a, b.seg_no AS seg_no_b FROM looks a JOIN looks b ON a.field = b.field AND a.f = b.f AND a.s <> b.s AND a.seg_no < b.seg_no"
P3_CLASSES = f"""WITH {_LOOKS}, k AS (SELECT field, f, count(*) AS n, min(seg_no) AS first FROM looks GROUP BY 1, 2 HAVING count(DISTINCT s) > 1)
SELECT seg_no, field, first, n - count(*) OVER (PARTITION BY field, f, s) AS links FROM looks JOIN k USING (field, f)"""

SQL = {"p1_found": P1_FOUND, "p2_found": P2_FOUND, "p2_overlap_by_split": P2_BY_SPLIT, "p3_found": P3_FOUND, "p3_classes": P3_CLASSES, "p4_found": P4_FOUND, "p6_found": P6_FOUND, "p7_found": P7_FOUND, "p7_groups": P7_GROUPS}
