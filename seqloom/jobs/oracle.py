"""The queries of the registry in SQL for DuckDB, composed of common table expressions."""

from __future__ import annotations

from ..functions.text import CLASS_SUFFIXES


def _r(x: str, digits: int = 6) -> str:
    return f"round({x}, {digits}) + CAST(0 AS DOUBLE)"


_CORPUS = """c AS (
  SELECT l_orderkey AS seq_id, row_number() OVER w - 1 AS pos, l_suppkey AS sym, count(*) OVER (PARTITION BY l_orderkey) AS len
  FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice))"""
_SYMBOLS = "sy AS (SELECT sym, CAST(count(*) AS DOUBLE) AS n, count(*) FILTER (pos = 0) AS starts, count(*) FILTER (pos = len - 1) AS ends FROM c GROUP BY sym)"
_ENTROPY = """pe AS (
  SELECT sym, greatest(0, sum(-p * log2(p))) / (SELECT log2(max(len)) FROM c) AS entropy
  FROM (SELECT sym, pos, count(*) / sum(count(*)) OVER (PARTITION BY sym) AS p FROM c GROUP BY sym, pos) GROUP BY sym)"""
_GRAMS = """g AS (SELECT seq_id, pos, sym AS a, lead(sym, 1) OVER q AS b, lead(sym, 2) OVER q AS c FROM c WINDOW q AS (PARTITION BY seq_id ORDER BY pos)),
bi AS (SELECT a, b, count(*) AS n FROM g WHERE b IS NOT NULL GROUP BY a, b),
tri AS (SELECT a, b, c, count(*) AS n FROM g WHERE c IS NOT NULL GROUP BY a, b, c),
k AS (SELECT CAST(sum(n) AS DOUBLE) AS n1, CAST(count(*) AS DOUBLE) AS v, sum(starts) AS all_starts, sum(ends) AS all_ends FROM sy),
kb AS (SELECT CAST(sum(n) AS DOUBLE) AS n2 FROM bi), kt AS (SELECT CAST(sum(n) AS DOUBLE) AS n3 FROM tri)"""
_NPMI = """u AS (SELECT sym, ln((n + 1) / (n1 + v)) AS lp FROM sy, k),
nb AS (SELECT a, b, n, CASE WHEN -l <= 1e-12 THEN 0 ELSE (l - ua - ub) / -l END AS npmi
       FROM (SELECT bi.*, ln((CAST(n AS DOUBLE) + 1) / (n2 + v * v)) AS l, x.lp AS ua, y.lp AS ub FROM bi JOIN u x ON x.sym = a JOIN u y ON y.sym = b, k, kb)),
nt AS (SELECT a, b, c, n, CASE WHEN -l <= 1e-12 THEN 0 ELSE (l - ua - ub - uc) / -l END AS npmi
       FROM (SELECT tri.*, ln((CAST(n AS DOUBLE) + 1) / (n3 + v * v * v)) AS l, x.lp AS ua, y.lp AS ub, z.lp AS uc
             FROM tri JOIN u x ON x.sym = a JOIN u y ON y.sym = b JOIN u z ON z.sym = c, k, kt))"""
_STATS = f"{_CORPUS},\n{_SYMBOLS},\n{_ENTROPY},\n{_GRAMS},\n{_NPMI}"
_FEATURES = f"""{_STATS},
w AS (SELECT seq_id, pos, len, lag(sym, 2) OVER q AS s2, lag(sym, 1) OVER q AS s1, sym, lead(sym, 1) OVER q AS nx FROM c WINDOW q AS (PARTITION BY seq_id ORDER BY pos)),
f AS (
  SELECT w.seq_id, w.pos, n0.npmi AS f0, coalesce(n1b.npmi, -1) AS f1, coalesce(n2b.npmi, -1) AS f2, greatest(-1, coalesce(t1.npmi, -1), coalesce(t2.npmi, -1)) AS f3,
         abs(er.entropy - el.entropy) AS f4, er.entropy - el.entropy AS f5, (l.n / k.n1 + r.n / k.n1) / 2 AS f6, (l.starts + CAST(1 AS DOUBLE)) / (k.all_starts + k.v) AS f7, (r.ends + CAST(1 AS DOUBLE)) / (k.all_ends + k.v) AS f8,
         CASE WHEN len > 2 THEN (w.pos - 1) / CAST(greatest(1, len - 2) AS DOUBLE) ELSE CAST(0.5 AS DOUBLE) END AS f9, (l.n + 1) / (r.n + 1) AS f10,
         CAST(l.starts > CAST(0.01 AS DOUBLE) * k.all_starts AS INTEGER)::DOUBLE AS f11, CAST(r.ends > CAST(0.01 AS DOUBLE) * k.all_ends AS INTEGER)::DOUBLE AS f12
  FROM w JOIN sy l ON l.sym = w.s1 JOIN sy r ON r.sym = w.sym JOIN pe el ON el.sym = w.s1 JOIN pe er ON er.sym = w.sym
  JOIN nb n0 ON n0.a = w.s1 AND n0.b = w.sym LEFT JOIN nb n1b ON n1b.a = w.s2 AND n1b.b = w.s1 LEFT JOIN nb n2b ON n2b.a = w.sym AND n2b.b = w.nx
  LEFT JOIN nt t1 ON t1.a = w.s2 AND t1.b = w.s1 AND t1.c = w.sym LEFT JOIN nt t2 ON t2.a = w.s1 AND t2.b = w.sym AND t2.c = w.nx, k
  WHERE w.pos >= 1)"""
_SEGMENTS = f"""{_FEATURES},
m AS (SELECT avg(f0) AS mean, stddev_pop(f0) AS std FROM f),
z AS (SELECT f.seq_id, f.pos, f0, (std < 1e-8 OR f0 <= mean) AS hit FROM f, m),
z2 AS (SELECT seq_id, pos, hit OR (NOT bool_or(hit) OVER (PARTITION BY seq_id) AND row_number() OVER (PARTITION BY seq_id ORDER BY f0, pos) = 1) AS cut FROM z),
n AS (SELECT c.seq_id, c.pos, c.sym, sum(CASE WHEN cut THEN 1 ELSE 0 END) OVER (PARTITION BY c.seq_id ORDER BY c.pos) AS seg_pos FROM c LEFT JOIN z2 ON z2.seq_id = c.seq_id AND z2.pos = c.pos),
s0 AS (SELECT seq_id, CAST(seg_pos AS INTEGER) AS seg_pos, string_agg(CAST(sym AS VARCHAR), ',' ORDER BY pos) AS seg_key, list(sym ORDER BY pos) AS tokens FROM n GROUP BY seq_id, seg_pos),
s AS (SELECT *, count(*) OVER (PARTITION BY seq_id) AS n_segs FROM s0)"""
_CONTEXTS = f"""{_SEGMENTS},
pr AS (SELECT a, b, count(*) AS n FROM (SELECT seg_key AS b, lag(seg_key) OVER (PARTITION BY seq_id ORDER BY seg_pos) AS a FROM s) WHERE a IS NOT NULL GROUP BY a, b),
x AS (SELECT b AS seg_key, 'left' AS side, a AS nbr, n FROM pr UNION ALL SELECT a, 'right', b, n FROM pr),
xs AS (SELECT *, n / sum(n) OVER (PARTITION BY seg_key, side) AS p FROM x),
hs AS (SELECT seg_key, coalesce(sum(-p * ln(p)) FILTER (side = 'left'), 0) AS hl, coalesce(sum(-p * ln(p)) FILTER (side = 'right'), 0) AS hr,
              (coalesce(sum(p * p) FILTER (side = 'left'), 0) + coalesce(sum(p * p) FILTER (side = 'right'), 0)) / 2 AS skew FROM xs GROUP BY seg_key),
ps AS (SELECT seg_key, seq_id, count(*) AS c, any_value(tokens) AS tokens, count(*) FILTER (seg_pos = 0) AS starts, count(*) FILTER (seg_pos = n_segs - 1) AS ends,
              sum(seg_pos / CAST(greatest(1, n_segs - 1) AS DOUBLE)) AS places FROM s GROUP BY seg_key, seq_id),
sc AS (SELECT seg_key, any_value(tokens) AS tokens, CAST(sum(c) AS BIGINT) AS freq, count(*) AS docfreq, sum(c * c) AS squares, sum(starts) AS starts, sum(ends) AS ends, sum(places) / sum(c) AS avg_pos FROM ps GROUP BY seg_key),
sq AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM s WHERE seg_pos = 0),
ku AS (SELECT CAST(sum(freq) AS DOUBLE) AS n1, CAST(count(*) AS DOUBLE) AS v FROM sc), kx AS (SELECT CAST(sum(n) AS DOUBLE) AS n2 FROM pr),
pm AS (SELECT x.seg_key, x.side, ln((CAST(x.n AS DOUBLE) + 1) / (n2 + v * v)) - ln((CAST(a.freq AS DOUBLE) + 1) / (n1 + v)) - ln((CAST(b.freq AS DOUBLE) + 1) / (n1 + v)) AS pmi
       FROM x JOIN sc a ON a.seg_key = x.seg_key JOIN sc b ON b.seg_key = x.nbr, ku, kx),
ap AS (SELECT seg_key, avg(pmi) FILTER (side = 'left') AS l, avg(pmi) FILTER (side = 'right') AS r FROM pm GROUP BY seg_key),
nu AS (SELECT seg_key, (len(tokens) = 1 AND tokens[1] BETWEEN 0 AND 200) OR (len(tokens) = 2 AND tokens[1] BETWEEN 0 AND 50 AND tokens[2] BETWEEN 0 AND 50) AS numeric FROM sc),
an AS (SELECT x.seg_key, sum(CASE WHEN numeric THEN n ELSE 0 END) AS num_adj, sum(n) AS total_adj FROM x JOIN nu ON nu.seg_key = x.nbr GROUP BY x.seg_key),
ad AS (SELECT sc.seg_key, coalesce(num_adj, 0)::DOUBLE AS num_adj, coalesce(total_adj, 0)::DOUBLE AS total_adj FROM sc LEFT JOIN an ON an.seg_key = sc.seg_key),
al AS (SELECT sum(num_adj) AS all_num, sum(total_adj) AS all_adj FROM ad),
fm AS (
  SELECT sc.seg_key, freq, docfreq, sc.starts / freq AS start_prob, sc.ends / freq AS end_prob, avg_pos, CAST(len(tokens) AS DOUBLE) AS mean_len,
         coalesce(hl, 0) AS H_left, coalesce(hr, 0) AS H_right, coalesce(hl, 0) + coalesce(hr, 0) AS H_total, coalesce(skew, 0) AS coll_skew, coalesce(ap.l, 0) AS avg_pmi_left, coalesce(ap.r, 0) AS avg_pmi_right,
         num_adj / greatest(1, total_adj) AS numeric_assoc, greatest(0, squares / n - (freq / n) * (freq / n)) / (freq / n + 1e-12) AS burstiness, ln((n + 1) / (docfreq + 1)) AS idf
  FROM sc LEFT JOIN hs ON hs.seg_key = sc.seg_key LEFT JOIN ap ON ap.seg_key = sc.seg_key JOIN ad ON ad.seg_key = sc.seg_key, sq),
mk AS (SELECT quantile_cont(CAST(freq AS DOUBLE), 0.5) AS mid, quantile_cont(H_total, 0.6) AS high FROM fm),
sd AS (SELECT seg_key, numeric_assoc >= 0.6::DOUBLE AND freq >= mid AS commodity, start_prob >= 0.6::DOUBLE AND coll_skew >= 0.12::DOUBLE AS title, freq <= mid AND H_total >= high AS proper_name FROM fm, mk),
lb AS (SELECT seg_key, CASE WHEN commodity THEN 'commodity' WHEN title THEN 'title' ELSE 'proper_name' END AS label FROM sd)"""
_CLASSES = """cl AS (
  SELECT l_linestatus AS corpus, l_orderkey AS seq_id,
         list(CASE l_returnflag WHEN 'A' THEN 'title' WHEN 'N' THEN 'commodity' WHEN 'R' THEN 'proper_name' END
              ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice, CASE l_returnflag WHEN 'A' THEN 'title' WHEN 'N' THEN 'commodity' WHEN 'R' THEN 'proper_name' END) AS labels
  FROM lineitem GROUP BY l_linestatus, l_orderkey),
lc AS (SELECT corpus, label, count(*) AS n FROM (SELECT corpus, unnest(labels) AS label FROM cl) GROUP BY corpus, label),
lf AS (SELECT label, CAST(coalesce(sum(n) FILTER (corpus = 'F'), 0) AS DOUBLE) AS f1, CAST(coalesce(sum(n) FILTER (corpus = 'O'), 0) AS DOUBLE) AS f2 FROM lc GROUP BY label),
st AS (SELECT array_to_string(labels, ',') AS pattern, CAST(count(*) FILTER (corpus = 'F') AS DOUBLE) AS f1, CAST(count(*) FILTER (corpus = 'O') AS DOUBLE) AS f2 FROM cl GROUP BY 1),
sp AS (SELECT corpus, array_to_string(list_transform(labels, lambda x: CASE x WHEN 'proper_name' THEN 'S' WHEN 'title' THEN 'V' WHEN 'commodity' THEN 'O' ELSE '?' END), '') AS pattern FROM cl),
sf AS (SELECT pattern, CAST(count(*) FILTER (corpus = 'F') AS DOUBLE) AS f1, CAST(count(*) FILTER (corpus = 'O') AS DOUBLE) AS f2 FROM sp GROUP BY pattern),
ce AS (SELECT corpus, sum(-p * log2(p)) AS e FROM (SELECT corpus, n / sum(n) OVER (PARTITION BY corpus) AS p FROM lc) GROUP BY corpus),
es AS (SELECT coalesce(max(e) FILTER (corpus = 'F'), 0) AS e1, coalesce(max(e) FILTER (corpus = 'O'), 0) AS e2 FROM ce),
v_e AS (SELECT e1, e2, CASE WHEN greatest(e1, e2) = 0 THEN CAST(1 AS DOUBLE) ELSE 1 - abs(e1 - e2) / greatest(e1, e2) END AS similarity FROM es),
v_c AS (SELECT sum(f1 * f2) / (sqrt(sum(f1 * f1)) * sqrt(sum(f2 * f2))) AS similarity FROM lf),
v_j AS (SELECT CAST(count(*) FILTER (f1 > 0 AND f2 > 0) AS DOUBLE) / count(*) FILTER (f1 > 0 OR f2 > 0) AS similarity FROM lf),
v_d AS (SELECT CASE WHEN sum(f1) = 0 OR sum(f2) = 0 THEN 0 ELSE avg(2 * least(f1, f2) / (f1 + f2)) END AS similarity FROM st),
v_s AS (SELECT avg(2 * least(f1, f2) / (f1 + f2)) AS similarity FROM sf)"""


def _norm(x: str) -> str:
    r"""Text normalization; \s of both dialects is widened to all white space."""
    space = r"[\s\x{0B}\x{1C}-\x{1F}\x{85}\p{Z}]"
    trimmed = f"lower(regexp_replace(coalesce({x}, ''), '^{space}+|{space}+$', '', 'g'))"
    kept = rf"regexp_replace({trimmed}, '[^\x{{0B80}}-\x{{0BFF}}a-zA-Z0-9\s\x{{0B}}\x{{85}}\p{{Z}}]', '', 'g')"
    return f"trim(regexp_replace({kept}, '{space}+', ' ', 'g'))"


_PHRASES = f"""ph AS (SELECT text, min(cand_id) AS cand_id FROM (SELECT {_norm("p_name")} AS text, p_partkey AS cand_id FROM part) WHERE text <> '' GROUP BY text),
pb AS (SELECT text AS word, cand_id, CAST(greatest(1, length(text) // 3) AS INTEGER) AS bucket FROM ph)"""
_QUERIES = f"""{_SEGMENTS},
{_PHRASES},
qt AS (SELECT DISTINCT array_to_string(tokens, ' ') AS text FROM s),
qb AS (SELECT text, greatest(1, length(text) // 3) AS bucket FROM qt),
qp AS (SELECT qb.text, pb.word, pb.cand_id, pb.bucket FROM qb JOIN pb ON pb.bucket BETWEEN greatest(1, qb.bucket - 2) AND qb.bucket + 2
       UNION ALL SELECT qb.text, pb.word, pb.cand_id, pb.bucket FROM qb, pb
       WHERE NOT EXISTS (SELECT 1 FROM pb p2 WHERE p2.bucket BETWEEN greatest(1, qb.bucket - 2) AND qb.bucket + 2))"""
_WORDS = "wd AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS word FROM part)"


def _suffixes() -> str:
    return " * ".join(f"CASE WHEN label = '{label}' AND ends_with(w, '{x}') THEN CAST(1.1 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END" for label, ends in CLASS_SUFFIXES.items() for x in ends)


def _similar(a: str, b: str) -> str:
    return f"CASE WHEN {a} <= 0 OR {b} <= 0 THEN CAST({a} = {b} AS INTEGER)::DOUBLE ELSE greatest(0, 1 - abs({a} - {b}) / CAST(greatest({a}, {b}) AS DOUBLE)) END"


def _seed_rows() -> str:
    rows = []
    for x in ("commodity", "title", "proper_name"):
        rows.append(f"""SELECT '{x}' AS label, count(*) FILTER ({x} AND label = '{x}') AS tp, count(*) FILTER (label = '{x}') AS pred_count, count(*) FILTER ({x}) AS seed_count FROM sd JOIN lb ON lb.seg_key = sd.seg_key""")
    return " UNION ALL ".join(rows)


_SCALED = ["start_prob", "end_prob", "avg_pos", "mean_len", "H_total", "burstiness", "idf", "coll_skew"]


def _scale(c: str) -> str:
    p = [f"(SELECT quantile_cont({c}, {q}) FROM fm)" for q in (0.25, 0.5, 0.75)]
    return f"{_r(f'({c} - {p[1]}) / CASE WHEN {p[2]} - {p[0]} < 1e-9 THEN 1 ELSE {p[2]} - {p[0]} END')} AS {c}"


_P = "t * (0.254829592::DOUBLE + t * (-0.284496736::DOUBLE + t * (1.421413741::DOUBLE + t * (-1.453152027::DOUBLE + t * 1.061405429::DOUBLE))))"
_DOUBLES = ["start_prob", "end_prob", "avg_pos", "mean_len", "H_left", "H_right", "H_total", "coll_skew", "avg_pmi_left", "avg_pmi_right", "numeric_assoc", "burstiness", "idf"]

#: The same of the first 30 orders of each corpus and first class.
_REPRESENTATIVES = _CLASSES.replace("cl AS (", "cl0 AS (", 1).replace(
    "lc AS (", "cl AS (SELECT corpus, seq_id, labels FROM (SELECT *, row_number() OVER (PARTITION BY corpus, labels[1] ORDER BY seq_id) AS k FROM cl0) WHERE k <= 30),\nlc AS (", 1
)

SQL = {
    "distribution_score": f"WITH {_CORPUS} SELECT sym, {_r('count(*) / CAST((SELECT count(*) FROM c) AS DOUBLE)')} AS score FROM c GROUP BY sym",
    "positional_entropy": f"WITH {_CORPUS}, {_ENTROPY} SELECT sym, {_r('entropy')} AS entropy FROM pe",
    "ngram_counts_uni": f"WITH {_CORPUS} SELECT sym, count(*) AS n FROM c GROUP BY sym",
    "start_end_counts": f"WITH {_CORPUS}, {_SYMBOLS} SELECT sym, starts, ends FROM sy",
    "ngram_counts_bi": f"WITH {_STATS} SELECT a, b, n FROM bi",
    "ngram_counts_tri": f"WITH {_STATS} SELECT a, b, c, n FROM tri",
    "npmi_bigram": f"WITH {_STATS} SELECT a, b, n, {_r('npmi')} AS npmi FROM nb",
    "npmi_trigram": f"WITH {_STATS} SELECT a, b, c, n, {_r('npmi')} AS npmi FROM nt",
    "boundary_features": f"WITH {_FEATURES} SELECT seq_id, pos, {', '.join(f'{_r(f"f{i}")} AS f{i}' for i in range(13))} FROM f",
    "zscore_boundary": f"""WITH {_SEGMENTS},
zz AS (SELECT seq_id, pos, hit, (f0 - mean) / (std + 1e-12) AS v, std FROM z, m),
zt AS (SELECT *, abs(v) / sqrt(2) AS y, 1 / (1 + 0.3275911::DOUBLE * abs(v) / sqrt(2)) AS t FROM zz),
ze AS (SELECT *, 1 - {_P} * exp(-y * y) AS e FROM zt)
SELECT seq_id, pos, hit AS is_boundary, {_r("CASE WHEN std < 1e-8 OR v = 0 THEN CAST(0.5 AS DOUBLE) WHEN v > 0 THEN greatest(0, 1 - (1 + e) / 2) ELSE 1 - (1 - e) / 2 END", 5)} AS p FROM ze""",
    "score_lines": f"WITH {_CORPUS} SELECT CAST(sym AS VARCHAR) || chr(9) || printf('%.6f', count(*) / CAST((SELECT count(*) FROM c) AS DOUBLE)) AS value FROM c GROUP BY sym",
    "association_histogram": f"""WITH {_FEATURES}, hv AS (SELECT {_r("f0")} AS x FROM f), he AS (SELECT min(x) AS lo, max(x) AS hi FROM hv),
hn AS (SELECT CAST(least(59, floor((x - lo) / (hi - lo) * 60)) AS BIGINT) AS bin, count(*) AS n FROM hv, he GROUP BY 1)
SELECT b.bin, {_r("lo + (hi - lo) * b.bin / 60")} AS low, {_r("lo + (hi - lo) * (b.bin + 1) / 60")} AS high, coalesce(hn.n, 0) AS n
FROM (SELECT unnest(generate_series(0, 59)) AS bin) b LEFT JOIN hn ON hn.bin = b.bin, he""",
    "segmented_lines": f"WITH {_SEGMENTS} SELECT seq_id, string_agg(array_to_string(tokens, ', '), ' | ' ORDER BY seg_pos) AS line FROM s GROUP BY seq_id",
    "segment_inventory": f"""WITH {_SEGMENTS}, i AS (SELECT seg_key, count(*) AS freq FROM s GROUP BY seg_key)
SELECT seg_key, printf('seg_%05d', row_number() OVER (ORDER BY freq DESC, seg_key)) AS seg_id, freq, least(10, freq) AS n_examples FROM i""",
    "top_examples": f"""WITH {_SEGMENTS} SELECT seg_key, seq_id AS seq, seg_pos AS pos FROM s
QUALIFY row_number() OVER (PARTITION BY seg_key ORDER BY seq_id, seg_pos) <= 10""",
    "segment_contexts": f"WITH {_CONTEXTS} SELECT seg_key, side, nbr, n FROM x",
    "segment_entropy": f"WITH {_CONTEXTS} SELECT seg_key, {_r('hl')} AS H_left, {_r('hr')} AS H_right, {_r('hl + hr')} AS H_total FROM hs",
    "segment_avg_pmi": f"WITH {_CONTEXTS} SELECT sc.seg_key, {_r('coalesce(l, 0)')} AS avg_pmi_left, {_r('coalesce(r, 0)')} AS avg_pmi_right FROM sc LEFT JOIN ap ON ap.seg_key = sc.seg_key",
    "segment_burstiness": f"WITH {_CONTEXTS} SELECT seg_key, {_r('burstiness')} AS burstiness FROM fm",
    "segment_idf_skew": f"WITH {_CONTEXTS} SELECT seg_key, {_r('idf')} AS idf, {_r('coll_skew')} AS coll_skew FROM fm",
    "numeric_assoc": f"WITH {_CONTEXTS} SELECT seg_key, {_r('numeric_assoc')} AS numeric_assoc FROM fm",
    "log_odds": f"""WITH {_CONTEXTS} SELECT seg_key, {_r("ln((num_adj + 0.5) * (greatest(0, all_adj - all_num - total_adj + num_adj) + 0.5) / ((total_adj - num_adj + 0.5) * (greatest(0, all_num - num_adj) + 0.5)) + 1e-300)")} AS log_odds FROM ad, al""",
    "g2_test": f"""WITH {_CONTEXTS}, pq AS (SELECT seg_key, total_adj, num_adj / total_adj AS p, all_num / all_adj AS q FROM ad, al)
SELECT seg_key, {_r("CASE WHEN total_adj > 0 AND p > 0 AND p < 1 AND q > 0 AND q < 1 THEN 2 * total_adj * (p * ln(p / q) + (1 - p) * ln((1 - p) / (1 - q))) ELSE 0 END")} AS g2 FROM pq""",
    "segment_features": f"WITH {_CONTEXTS} SELECT seg_key, freq, docfreq, {', '.join(f'{_r(c)} AS {c}' for c in _DOUBLES)} FROM fm",
    "seed_sets": f"WITH {_CONTEXTS} SELECT seg_key, commodity, title, proper_name FROM sd",
    "seed_precision": f"""WITH {_CONTEXTS}, e AS ({_seed_rows()})
SELECT label, CASE WHEN seed_count > 0 THEN {_r("CASE WHEN pred_count > 0 THEN tp / pred_count ELSE 0 END")} END AS precision_proxy,
       CASE WHEN seed_count > 0 THEN {_r("tp / seed_count")} END AS recall_proxy, tp, pred_count, seed_count FROM e""",
    "coverage": f"""WITH {_CONTEXTS}, h AS (SELECT s.seq_id, count(*) AS n, count(lb.seg_key) AS hits FROM s LEFT JOIN lb ON lb.seg_key = s.seg_key GROUP BY s.seq_id)
SELECT CAST(sum(hits) AS BIGINT) AS covered_positions, CAST(sum(n) AS BIGINT) AS total_positions, {_r("sum(hits) / CAST(sum(n) AS DOUBLE) * 100")} AS pct, count(*) FILTER (hits > 0) AS sequences_with_any, count(*) AS total_sequences FROM h""",
    "robust_scale": f"WITH {_CONTEXTS} SELECT seg_key, {', '.join(map(_scale, _SCALED))} FROM fm",
    "svo_patterns": f"WITH {_CLASSES} SELECT corpus, pattern, count(*) AS n FROM sp GROUP BY corpus, pattern",
    "class_entropy_similarity": f"WITH {_CLASSES} SELECT {_r('e1')} AS entropy_1, {_r('e2')} AS entropy_2, {_r('similarity')} AS similarity FROM v_e",
    "label_cosine": f"WITH {_CLASSES} SELECT {_r('similarity')} AS similarity FROM v_c",
    "jaccard_classes": f"WITH {_CLASSES} SELECT {_r('similarity')} AS similarity FROM v_j",
    "dice_structure": f"WITH {_CLASSES} SELECT {_r('similarity')} AS similarity FROM v_d",
    "svo_similarity": f"WITH {_CLASSES} SELECT {_r('similarity')} AS similarity FROM v_s",
    "overall_similarity": f"""WITH {_CLASSES}
SELECT round(v_e.similarity, 4) AS entropy_similarity, round(v_c.similarity, 4) AS order_similarity, round(v_j.similarity, 4) AS semantic_similarity, round(v_d.similarity, 4) AS structure_similarity,
       round(v_s.similarity, 4) AS svo_similarity, round(e1, 4) AS entropy_1, round(e2, 4) AS entropy_2,
       round(20 * (v_e.similarity + v_c.similarity + v_j.similarity + v_d.similarity + v_s.similarity), 2) AS overall_similarity_percent
FROM v_e, v_c, v_j, v_d, v_s""",
    "summary_comparison": f"""WITH a AS (WITH {_CLASSES} SELECT e1, e2, v_e.similarity AS e, v_j.similarity AS j FROM v_e, v_j),
b AS (WITH {_REPRESENTATIVES} SELECT v_c.similarity AS c, v_d.similarity AS d, v_s.similarity AS s FROM v_c, v_d, v_s),
n AS (WITH {_REPRESENTATIVES} SELECT CAST(sum(len(labels)) FILTER (corpus = 'F') AS BIGINT) AS n1, CAST(sum(len(labels)) FILTER (corpus = 'O') AS BIGINT) AS n2 FROM cl)
SELECT round(e, 4) AS entropy_similarity, round(c, 4) AS order_similarity, round(j, 4) AS semantic_similarity, round(d, 4) AS structure_similarity, round(s, 4) AS svo_similarity,
       round(e1, 4) AS entropy_1, round(e2, 4) AS entropy_2, round(20 * (e + c + j + d + s), 2) AS overall_similarity_percent, n1 AS n_labels_1, n2 AS n_labels_2
FROM a, b, n""",
    "parse_sequences": r"""WITH b AS (SELECT event_id, regexp_replace(coalesce(props, ''), '^\s+|\s+$', '', 'g') AS v FROM events),
i AS (SELECT event_id, CASE WHEN length(v) >= 2 AND (v[1] || v[length(v)] IN ('()', '[]', '{}')) THEN substring(v, 2, length(v) - 2) ELSE v END AS v FROM b),
t AS (SELECT event_id, list_transform(string_split_regex(regexp_replace(v, '[;,|]+', ' ', 'g'), '\s+'), lambda x: regexp_extract(x, '(-?\d+)', 1)) AS t FROM i)
SELECT event_id, array_to_string(list_transform(list_filter(t, lambda x: x <> ''), lambda x: CAST(CAST(x AS BIGINT) AS VARCHAR)), ',') AS symbols FROM t""",
    "normalize_text": f"SELECT conv_id, turn, md5({_norm('text')}) AS text_md5 FROM conversations",
    "strip_diacritics": "SELECT conv_id, turn, md5(strip_accents(text)) AS text_md5 FROM conversations",
    "corpus_dedup": f"WITH {_PHRASES} SELECT text, cand_id FROM ph",
    "length_bucket_join": f"WITH {_QUERIES} SELECT text, count(*) AS n_candidates, min(word) AS first_word, max(word) AS last_word FROM qp GROUP BY text",
    "lexicon_lookup": f"""WITH {_QUERIES}, lx AS (SELECT CAST(p_partkey AS VARCHAR) AS key, {_norm("p_name")} AS words FROM part)
SELECT qt.text, words FROM qt LEFT JOIN lx ON lx.key = qt.text AND words <> ''""",
    "linguistic_weight": f"""WITH {_WORDS}, wl AS (SELECT word, unnest(['title', 'proper_name', 'commodity']) AS label, {_norm("word")} AS w FROM wd)
SELECT word, label, {_r(f"greatest(0.75::DOUBLE, least(1.25::DOUBLE, {_suffixes()} * CASE WHEN length(w) <= 2 THEN 0.9::DOUBLE ELSE 1::DOUBLE END))")} AS weight FROM wl""",
    "structure_and_length_pairs": f"""WITH {_QUERIES},
d AS (SELECT text, bucket, {_similar("length(text)", "length(word)")} AS e, {_similar("1", "greatest(1, length(word) // 3)")} AS s FROM qp)
SELECT text, bucket, count(*) AS n_pairs, {_r("sum(e)")} AS length_sum, {_r("max(e)")} AS length_most, {_r("sum(s)")} AS structure_sum, {_r("max(s)")} AS structure_most FROM d GROUP BY text, bucket""",
    "summary_maps": f"""WITH a AS (WITH {_CLASSES} SELECT corpus, label, n FROM lc), b AS (WITH {_REPRESENTATIVES} SELECT corpus, pattern, count(*) AS n FROM sp GROUP BY corpus, pattern)
SELECT CASE corpus WHEN 'F' THEN 1 ELSE 2 END AS side, 'class_counts' AS map, label AS key, CAST(n AS BIGINT) AS n FROM a
UNION ALL SELECT CASE corpus WHEN 'F' THEN 1 ELSE 2 END, 'svo_patterns', pattern, CAST(n AS BIGINT) FROM b""",
}
