"""DuckDB SQL of the registered queries, put together from named steps.

STEPS maps a step to (the steps it needs, its query); `statement` writes the WITH clause of a query's steps in their order.
"""

from __future__ import annotations

_VERTICAL = "CASE WHEN p_type IN ('ECONOMY', 'STANDARD') THEN 'food' WHEN p_type IN ('SMALL', 'MEDIUM') THEN 'quik' ELSE 'shops' END"
_METRICS = ", ".join(f"CASE WHEN rank <= {k} THEN 1.0 ELSE 0.0 END AS hit_at_{k}, CASE WHEN rank <= {k} THEN 1 / log2(rank + 1) ELSE 0.0 END AS ndcg_at_{k}" for k in (5, 10, 20))
_MEANS = ", ".join(f"round(avg({m}), 6) AS {m}" for m in [*(f"{m}_at_{k}" for k in (5, 10, 20) for m in ("hit", "ndcg")), "mrr"])


def _walk(edges: str, transfer: float, length: int = 3, restart: float = 0.25) -> str:
    """Steps of a walk over `edges`, as nested selects."""
    steps = [f"{edges}_seed AS (SELECT user_id, vertical, i AS node, sum(w * CASE WHEN inside THEN 1.0 ELSE {transfer} END) AS w FROM seed_parts GROUP BY ALL HAVING sum(w * CASE WHEN inside THEN 1.0 ELSE {transfer} END) > 0)"]
    before = f"{edges}_seed"
    for n in range(length):
        steps.append(
            f"{edges}_state{n} AS (SELECT user_id, vertical, node, sum(w) AS w FROM (SELECT s.user_id, s.vertical, e.dst AS node, s.w * e.w * {1 - restart} AS w FROM {before} s JOIN {edges} e ON e.src = s.node"
            f" UNION ALL SELECT user_id, vertical, node, w * {restart} FROM {edges}_seed) GROUP BY ALL)"
        )
        before = f"{edges}_state{n}"
    return ", ".join(steps)


def _walk_scores(edges: str, transfer: float) -> str:
    total = " UNION ALL ".join(f"SELECT * FROM {edges}_state{n}" for n in range(3))
    return f"""WITH {_walk(edges, transfer)}
        SELECT r.user_id, r.target, r.vertical, c.item_id, sum(t.w) AS score FROM ({total}) t JOIN pool c ON 'item=' || c.item_id = t.node AND c.vertical = t.vertical
        JOIN rows r ON r.user_id = t.user_id AND r.vertical = t.vertical GROUP BY ALL"""


STEPS: dict[str, tuple[tuple[str, ...], str]] = {
    "part_items": ((), f"SELECT p_partkey AS item_id, {_VERTICAL} AS vertical, {_VERTICAL} || ':' || p_brand AS category, (p_size - 1) // 13 + 1 AS price_band FROM part"),
    "positives": (("part_items",), "SELECT o_custkey AS user_id, l_partkey AS item_id, vertical, o_orderdate AS ts, l_orderkey AS session_id, l_linenumber AS line FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part_items ON l_partkey = item_id WHERE l_quantity >= 43"),
    "log": (("positives",), "SELECT * FROM positives WHERE user_id IN (SELECT user_id FROM positives GROUP BY user_id HAVING count(*) >= 5)"),
    "items": (("part_items", "log"), "SELECT * FROM part_items WHERE item_id IN (SELECT item_id FROM log)"),
    "placed": (("log",), "SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, session_id DESC, line DESC, item_id DESC) - 1 AS back FROM log"),
    "split": (("placed",), """SELECT *, CASE WHEN back >= 2 THEN 'train' WHEN item_id NOT IN (SELECT item_id FROM placed WHERE back >= 2) THEN NULL WHEN back = 1 THEN 'val' ELSE 'test' END AS part FROM placed"""),
    "train": (("split",), "SELECT * FROM split WHERE part = 'train'"),
    "seen": (("train",), "SELECT DISTINCT user_id, item_id FROM train"),
    "pop": (("items", "seen"), "SELECT i.item_id, i.vertical, count(s.user_id) AS pop FROM items i LEFT JOIN seen s ON s.item_id = i.item_id GROUP BY ALL"),
    "pool": (("pop", "split"), """SELECT item_id, vertical, pop FROM (SELECT *, row_number() OVER (PARTITION BY vertical ORDER BY pop DESC, item_id) AS place FROM pop)
        WHERE place <= 3000 OR item_id IN (SELECT item_id FROM split WHERE part IN ('test', 'val'))"""),
    "pop_pct": (("pop",), "SELECT item_id, (rank() OVER (ORDER BY pop) + (count(*) OVER (PARTITION BY pop) - 1) / 2) / count(*) OVER () AS pct FROM pop"),
    "rows": (("train", "split", "pop_pct"), """SELECT *, in_vertical_hist <= 2 AS cold_in_vertical, n_hist_verticals >= 2 AS cross_vertical_user, in_vertical_hist <= 2 AND n_hist_verticals >= 2 AS transfer_only, target_pop_pct < 0.70 AS tail_target
        FROM (SELECT s.user_id, s.item_id AS target, s.vertical, h.n AS hist_len, h.v AS n_hist_verticals, coalesce(x.n, 0) AS in_vertical_hist, p.pct AS target_pop_pct
            FROM split s JOIN (SELECT user_id, count(*) AS n, count(DISTINCT vertical) AS v FROM train GROUP BY 1) h ON h.user_id = s.user_id
            LEFT JOIN (SELECT user_id, vertical, count(*) AS n FROM train GROUP BY 1, 2) x ON x.user_id = s.user_id AND x.vertical = s.vertical
            JOIN pop_pct p ON p.item_id = s.item_id WHERE s.part = 'test')"""),
    "pairs": (("rows", "pool"), "SELECT r.user_id, r.target, r.vertical, c.item_id, c.pop FROM rows r JOIN pool c ON c.vertical = r.vertical"),
    "open_pairs": (("pairs", "seen"), "SELECT p.* FROM pairs p LEFT JOIN seen s ON s.user_id = p.user_id AND s.item_id = p.item_id WHERE s.item_id IS NULL OR p.item_id = p.target"),
    "score_popularity": (("pairs",), "SELECT user_id, target, vertical, item_id, CAST(pop AS DOUBLE) AS score FROM pairs"),
    "co": (("seen",), "SELECT a.item_id AS i, b.item_id AS j, count(*) AS co FROM seen a JOIN seen b ON a.user_id = b.user_id AND a.item_id <> b.item_id GROUP BY 1, 2"),
    "knn": (("co", "pop"), """SELECT i, j, similarity FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY similarity DESC, j) AS place
        FROM (SELECT i, j, round(co / ((sqrt(x.pop) + 10) * (sqrt(y.pop) + 10)), 12) AS similarity FROM co JOIN pop x ON x.item_id = i JOIN pop y ON y.item_id = j)) WHERE place <= 150"""),
    "score_knn": (("knn", "seen", "rows", "pool"), """SELECT r.user_id, r.target, r.vertical, k.j AS item_id, sum(k.similarity) AS score FROM rows r JOIN seen s ON s.user_id = r.user_id JOIN knn k ON k.i = s.item_id
        JOIN pool c ON c.item_id = k.j AND c.vertical = r.vertical GROUP BY ALL"""),
    "walk_items": (("co", "pop"), """SELECT src, dst, w / sum(w) OVER (PARTITION BY src) AS w FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY w DESC, dst) AS place
        FROM (SELECT i AS src, j AS dst, round(co / (sqrt(greatest(x.pop, 1)) * sqrt(greatest(y.pop, 1))), 12) AS w FROM co JOIN pop x ON x.item_id = i JOIN pop y ON y.item_id = j)) WHERE place <= 150"""),
    "plain_edges": (("walk_items",), "SELECT 'item=' || src AS src, 'item=' || dst AS dst, w FROM walk_items"),
    "kg_edges": (("walk_items", "items"), """WITH tags AS (SELECT 'item=' || item_id AS item, unnest(['category=' || category, 'price_band=' || price_band, 'vertical=' || vertical]) AS tag FROM items)
        SELECT 'item=' || src AS src, 'item=' || dst AS dst, w * 0.65 AS w FROM walk_items UNION ALL SELECT item, tag, 0.35 / count(*) OVER (PARTITION BY item) FROM tags
        UNION ALL SELECT tag, item, 1.0 / count(*) OVER (PARTITION BY tag) FROM tags"""),
    "seed_parts": (("rows", "train"), """SELECT *, n / sum(n) OVER (PARTITION BY user_id, vertical, inside) AS w FROM (SELECT r.user_id, r.vertical, t.vertical = r.vertical AS inside, 'item=' || t.item_id AS i, count(*) AS n
        FROM (SELECT DISTINCT user_id, vertical FROM rows) r JOIN train t ON t.user_id = r.user_id GROUP BY ALL)"""),
    "score_walk_within": (("plain_edges", "seed_parts", "pool", "rows"), _walk_scores("plain_edges", 0.0)),
    "score_walk_xvert": (("plain_edges", "seed_parts", "pool", "rows"), _walk_scores("plain_edges", 0.6)),
    "score_walk_kg": (("kg_edges", "seed_parts", "pool", "rows"), _walk_scores("kg_edges", 0.6)),
    "user_cat": (("train", "items"), "SELECT t.user_id, i.category, count(*) AS n FROM train t JOIN items i ON i.item_id = t.item_id GROUP BY ALL"),
    "cat_co": (("user_cat",), "SELECT a.category AS a, b.category AS b, sum(a.n * b.n) AS co FROM user_cat a JOIN user_cat b ON a.user_id = b.user_id AND a.category <> b.category GROUP BY ALL"),
    "cat_margin": (("cat_co", "items"), "SELECT c.category, coalesce(sum(co), 0) AS margin FROM (SELECT DISTINCT category FROM items) c LEFT JOIN cat_co ON a = c.category GROUP BY 1"),
    "affinity": (("cat_margin", "cat_co"), """SELECT x.category AS a, y.category AS b, coalesce(co, 0) AS co,
        ln((coalesce(co, 0) + 5) / (x.margin * y.margin / greatest((SELECT sum(margin) FROM cat_margin), 1) + 5)) AS affinity
        FROM cat_margin x CROSS JOIN cat_margin y LEFT JOIN cat_co m ON m.a = x.category AND m.b = y.category"""),
    "user_value": (("affinity", "user_cat"), """WITH share AS (SELECT user_id, category, n / sum(n) OVER (PARTITION BY user_id) AS share FROM user_cat)
        SELECT user_id, category, sum(value) AS value FROM (SELECT user_id, b AS category, share * affinity AS value FROM share JOIN affinity ON a = category UNION ALL SELECT user_id, category, share FROM share) GROUP BY ALL"""),
    "score_bridge": (("pairs", "items", "user_value"), "SELECT p.user_id, p.target, p.vertical, p.item_id, coalesce(v.value, 0) + ln(1 + p.pop) AS score FROM pairs p JOIN items i ON i.item_id = p.item_id LEFT JOIN user_value v ON v.user_id = p.user_id AND v.category = i.category"),
}


def ranked(scores: str) -> str:
    """The ranks of a scoring step, by counting every open candidate: what isn't scored counts as 0."""
    return f"""SELECT r.*, o.rank FROM rows r JOIN (
        SELECT user_id, target, vertical, count(*) FILTER (score >= own) AS rank FROM (SELECT *, max(score) FILTER (item_id = target) OVER (PARTITION BY user_id, target, vertical) AS own
            FROM (SELECT p.user_id, p.target, p.vertical, p.item_id, round(coalesce(s.score, 0), 10) AS score FROM open_pairs p
                LEFT JOIN {scores} s ON s.user_id = p.user_id AND s.target = p.target AND s.item_id = p.item_id)) GROUP BY ALL
    ) o ON o.user_id = r.user_id AND o.target = r.target"""


for _name in ("popularity", "knn", "walk_within", "walk_xvert", "walk_kg", "bridge"):
    STEPS[f"rank_{_name}"] = (("rows", "open_pairs", f"score_{_name}"), ranked(f"score_{_name}"))
    STEPS[f"measured_{_name}"] = ((f"rank_{_name}",), f"SELECT *, {_METRICS}, 1 / rank AS mrr FROM rank_{_name}")
    STEPS[f"top_{_name}"] = (("open_pairs", f"score_{_name}"), f"""SELECT * FROM (SELECT s.*, row_number() OVER (PARTITION BY user_id, target, vertical ORDER BY round(score, 10) DESC, item_id) AS place
        FROM score_{_name} s SEMI JOIN open_pairs o ON o.user_id = s.user_id AND o.target = s.target AND o.item_id = s.item_id) WHERE place <= 10""")
STEPS["slates"] = (("top_walk_xvert", "top_popularity"), """WITH RECURSIVE lists AS (
        SELECT user_id, target, vertical, coalesce(list(item_id ORDER BY place) FILTER (a), []) AS a, coalesce(list(item_id ORDER BY place) FILTER (NOT a), []) AS b
        FROM (SELECT user_id, target, vertical, item_id, place, true AS a FROM top_walk_xvert UNION ALL SELECT user_id, target, vertical, item_id, place, false FROM top_popularity) GROUP BY ALL
    ), drawn AS (
        SELECT *, 0 AS slot, CAST([] AS BIGINT[]) AS slate, CAST(NULL AS VARCHAR) AS owner FROM lists
        UNION ALL
        SELECT user_id, target, vertical, a, b, slot + 1, list_append(slate, free[1]), CASE WHEN heads THEN 'a' ELSE 'b' END
        FROM (SELECT *, list_filter(CASE WHEN heads THEN a ELSE b END, lambda x: NOT list_contains(slate, x)) AS free
            FROM (SELECT *, md5(concat_ws('|', user_id, target, vertical, slot + 1, 0)) < '8' AS heads FROM drawn)) WHERE slot < 10 AND len(free) > 0
    )
    SELECT user_id, target, vertical, slate[-1] AS item_id, slot, owner FROM drawn WHERE slot > 0""")
STEPS["dense_knn"] = (("score_knn", "pairs"), """SELECT p.user_id, p.target, p.vertical, p.item_id, coalesce(s.score, 0) AS score FROM pairs p
    LEFT JOIN score_knn s ON s.user_id = p.user_id AND s.target = p.target AND s.vertical = p.vertical AND s.item_id = p.item_id""")
STEPS["paired"] = (("measured_walk_xvert", "measured_popularity"), "SELECT a.*, a.ndcg_at_10 AS x, b.ndcg_at_10 AS y FROM measured_walk_xvert a JOIN measured_popularity b ON a.user_id = b.user_id AND a.target = b.target")
SLICES = {"all": "true", "cold_in_vertical": "cold_in_vertical", "warm_in_vertical": "NOT cold_in_vertical", "transfer_only": "transfer_only", "single_vertical_user": "NOT cross_vertical_user", "tail_target": "tail_target"}
_BUCKET = "CAST('0x' || substr(md5(concat_ws('|', {}, '{}', 0)), 1, 7) AS BIGINT) % 200"
STEPS["replicates"] = (("paired",), f"""WITH sums AS (SELECT {_BUCKET.format('user_id', 'bucket')} AS bucket, count(*) AS n, sum(x - y) AS d, sum(y) AS y FROM paired GROUP BY 1)
    SELECT CAST(id // 200 AS INTEGER) AS replicate, CAST(sum(n) AS BIGINT) AS n, sum(d) / sum(n) AS delta, sum(y) / sum(n) AS baseline
    FROM (SELECT id, {_BUCKET.format('id', 'draw')} AS bucket FROM range(100000) t(id)) JOIN sums USING (bucket) GROUP BY 1""")
STEPS["arms"] = ((), """SELECT treated, count(*) AS n, avg(x) AS mean_x, avg(y) AS mean_y, avg(p) AS mean_p, coalesce(var_samp(x), 0) AS cov_xx, coalesce(var_samp(y), 0) AS cov_yy, coalesce(var_samp(p), 0) AS cov_pp,
    coalesce(covar_samp(x, y), 0) AS cov_xy, coalesce(covar_samp(x, p), 0) AS cov_xp
    FROM (SELECT user_id, md5(concat_ws('|', user_id, 'arm', 0)) < '8' AS treated, CAST(count(*) FILTER (event_type = 'click' AND day(ts) > 15) AS DOUBLE) AS x, CAST(count(*) FILTER (event_type = 'view' AND day(ts) > 15) AS DOUBLE) AS y,
        CAST(count(*) FILTER (event_type = 'click' AND day(ts) <= 15) AS DOUBLE) AS p, bool_or(day(ts) > 15) AS shown FROM events GROUP BY user_id) WHERE shown GROUP BY treated""")
STEPS["arm_pair"] = (("arms",), """SELECT a.n AS na, b.n AS nb, a.mean_x / a.mean_y AS ra, b.mean_x / b.mean_y AS rb, (a.n + b.n) / 2 AS even, a.mean_x - b.mean_x AS dx, a.mean_p - b.mean_p AS dp,
    (a.cov_xx - 2 * ra * a.cov_xy + ra * ra * a.cov_yy) / (a.mean_y * a.mean_y * a.n) + (b.cov_xx - 2 * rb * b.cov_xy + rb * rb * b.cov_yy) / (b.mean_y * b.mean_y * b.n) AS error,
    ((a.n - 1) * a.cov_xp + (b.n - 1) * b.cov_xp) / ((a.n - 1) * a.cov_pp + (b.n - 1) * b.cov_pp) AS theta, a.cov_xx / a.n + b.cov_xx / b.n AS plain,
    (a.cov_xx - 2 * theta * a.cov_xp + theta * theta * a.cov_pp) / a.n + (b.cov_xx - 2 * theta * b.cov_xp + theta * theta * b.cov_pp) / b.n AS less FROM arms a, arms b WHERE a.treated AND NOT b.treated""")
STEPS["ratings"] = (("part_items",), """SELECT o_custkey AS user_id, l_partkey AS item_id, vertical, date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) * 86400000 AS timestamp
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part_items ON l_partkey = item_id WHERE CAST(l_quantity / 10 AS FLOAT) >= 4""")
STEPS["gaps"] = ((), "SELECT user_id, ts, sum(CASE WHEN ts - before < INTERVAL 30 MINUTE THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts) AS session FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS before FROM events)")
STEPS["spans"] = (("gaps",), "SELECT user_id, min(ts) AS began, max(ts) + INTERVAL 30 MINUTE AS ended, count(*) AS n FROM gaps GROUP BY user_id, session")
_SPANS = "SELECT user_id, strftime(began, '%Y-%m-%d %H:%M:%S.%f') AS began, strftime(ended, '%Y-%m-%d %H:%M:%S.%f') AS ended, n FROM spans"
_SLICED = "unnest(list_filter([" + ", ".join(f"CASE WHEN {when} THEN '{name}' END" for name, when in SLICES.items()) + "], lambda s: s IS NOT NULL)) AS slice"


def statement(needs: tuple[str, ...], query: str) -> str:
    """WITH all the steps that `needs` lead to, then the query."""
    order: list[str] = []

    def add(step: str) -> None:
        if step not in order:
            for other in STEPS[step][0]:
                add(other)
            order.append(step)

    for step in needs:
        add(step)
    if not needs:
        return query
    if query.startswith("WITH"):
        query = f"SELECT * FROM ({query})"
    return "WITH " + ",\n".join(f"{s} AS MATERIALIZED ({STEPS[s][1]})" for s in order) + "\n" + query


def _round(table: str, keys: str = "user_id, target, vertical, item_id") -> tuple[tuple[str, ...], str]:
    return (table,), f"SELECT {keys}, round(score, 8) AS score FROM {table}"


_EVAL = "user_id, target, vertical, hist_len, n_hist_verticals, in_vertical_hist, cold_in_vertical, cross_vertical_user, transfer_only, round(target_pop_pct, 8) AS target_pop_pct, tail_target"
_SUMMARY = """count(*) AS n, CAST(sum(CASE WHEN x > 0 OR y > 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_informative, round(avg(y), 8) AS baseline, round(avg(x - y), 8) AS delta,
    round(100 * avg(x - y) / nullif(avg(y), 0), 4) AS rel_lift_pct, round(avg(CASE WHEN x > y THEN 1.0 ELSE 0.0 END), 8) AS win_rate"""

QUERIES: dict[str, tuple[tuple[str, ...], str]] = {
    "interaction_log": (("positives",), "SELECT user_id, item_id, vertical, ts, session_id, line FROM positives"),
    "item_dimension": (("items",), "SELECT item_id, vertical, category, CAST(price_band AS INTEGER) AS price_band FROM items"),
    "user_activity_filter": (("log",), "SELECT user_id, item_id, ts, session_id, line FROM log"),
    "item_frequency_filter": (("positives",), "SELECT user_id, item_id, session_id, line FROM positives WHERE item_id IN (SELECT item_id FROM positives GROUP BY 1 HAVING count(*) >= 10)"),
    "multi_vertical_users": (("positives",), "SELECT user_id, count(DISTINCT vertical) AS n_verticals, count(*) AS n FROM positives GROUP BY 1 HAVING count(DISTINCT vertical) >= 2"),
    "loo_split": (("split",), "SELECT user_id, item_id, session_id, line, back, part FROM split"),
    "train_only_targets": (("split",), "SELECT user_id, item_id, part FROM split WHERE part IN ('test', 'val')"),
    "item_popularity": (("pop",), "SELECT item_id, vertical, pop FROM pop"),
    "candidate_pool": (("pool",), "SELECT item_id, vertical, pop FROM pool"),
    "capped_candidate_pool": (("pop", "split"), """SELECT item_id, vertical, pop FROM (SELECT *, row_number() OVER (PARTITION BY vertical ORDER BY pop DESC, item_id) AS place FROM pop)
        WHERE place <= 100 OR item_id IN (SELECT item_id FROM split WHERE part IN ('test', 'val'))"""),
    "user_vertical_counts_pivot": (("train",), "SELECT user_id, " + ", ".join(f"count(*) FILTER (vertical = '{v}') AS {v}" for v in ("food", "quik", "shops")) + " FROM train GROUP BY 1"),
    "user_vertical_unpivot": (("train",), "SELECT user_id, vertical, count(*) AS n FROM train GROUP BY 1, 2"),
    "popularity_percentile": (("pop_pct",), "SELECT item_id, round(pct, 8) AS pct FROM pop_pct"),
    "eval_frame": (("rows",), f"SELECT {_EVAL} FROM rows"),
    "gini_popularity": (("pop",), "SELECT round(sum((2 * r - n - 1) * pop) / (max(n) * sum(pop)), 6) AS gini FROM (SELECT pop, row_number() OVER (ORDER BY pop, item_id) AS r, count(*) OVER () AS n FROM pop)"),
    "dataset_profile": (("log", "items", "pop", "rows"), """WITH users AS (SELECT user_id, count(*) AS n, count(DISTINCT vertical) AS v, count(DISTINCT session_id) AS s FROM log GROUP BY 1),
        g AS (SELECT round(sum((2 * r - n - 1) * pop) / (max(n) * sum(pop)), 6) AS gini FROM (SELECT pop, row_number() OVER (ORDER BY pop, item_id) AS r, count(*) OVER () AS n FROM pop))
        SELECT count(*) AS n_users, CAST(sum(n) AS BIGINT) AS n_events, CAST(floor(median(n)) AS BIGINT) AS median_history, round(100 * avg(CASE WHEN v >= 2 THEN 1.0 ELSE 0.0 END), 1) AS multi_vertical_user_pct, max(s) > 1 AS has_sessions,
        (SELECT count(*) FROM items) AS n_items, (SELECT gini FROM g) AS gini, (SELECT count(*) FROM rows) AS eval_rows, (SELECT round(100 * avg(CASE WHEN cold_in_vertical THEN 1.0 ELSE 0.0 END), 1) FROM rows) AS pct_cold_in_vertical,
        (SELECT round(100 * avg(CASE WHEN transfer_only THEN 1.0 ELSE 0.0 END), 1) FROM rows) AS pct_transfer_only, round(sum(n) / (count(*) * (SELECT count(*) FROM items)), 8) AS density FROM users"""),
    "seen_mask": (("open_pairs",), "SELECT user_id, target, count(*) AS n_open FROM open_pairs GROUP BY 1, 2"),
    "score_popularity": _round("score_popularity"),
    "rank_popularity": (("rank_popularity",), "SELECT user_id, target, vertical, rank FROM rank_popularity"),
    "metrics_popularity": (("measured_popularity",), f"SELECT count(*) AS n, {_MEANS}, round(avg(rank), 6) AS mean_rank FROM measured_popularity"),
    "slice_metrics": (("measured_popularity",), f"SELECT slice, count(*) AS n, {_MEANS} FROM (SELECT *, {_SLICED} FROM measured_popularity) GROUP BY slice HAVING count(*) >= 30"),
    "coverage_novelty": (("top_popularity", "pop", "items"), """SELECT round(count(DISTINCT t.item_id) / (SELECT count(*) FROM items), 6) AS coverage_at_10,
        round(avg(-log2(greatest(p.pop / (SELECT sum(pop) FROM pop), 1e-12))), 6) AS novelty_at_10 FROM top_popularity t JOIN pop p ON p.item_id = t.item_id"""),
    "top10_popularity": (("top_popularity",), "SELECT user_id, target, vertical, item_id, place FROM top_popularity"),
    "top10_knn": (("top_knn",), "SELECT user_id, target, vertical, item_id, place FROM top_knn"),
    "nonfinite_count": (("score_bridge",), "SELECT count(*) FILTER (score IS NULL OR NOT isfinite(score)) AS n_bad FROM score_bridge"),
    "item_cooccurrence": (("co",), "SELECT i, j, co FROM co"),
    "knn_similarity_topk": (("knn",), "SELECT i, j, round(similarity, 10) AS similarity FROM knn"),
    "knn_recency_profile": (("train",), """SELECT user_id, item_id AS i, round(sum(pow(0.5, age / 5.0)), 8) AS weight FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, session_id DESC, line DESC, item_id DESC) - 1 AS age FROM train) GROUP BY 1, 2"""),
    "score_knn": _round("score_knn"),
    "rank_knn": (("rank_knn",), "SELECT user_id, target, vertical, rank FROM rank_knn"),
    "walk_edges": (("walk_items",), "SELECT src, dst, round(w, 8) AS w FROM walk_items"),
    "kg_edges": (("kg_edges",), "SELECT src, dst, round(w, 8) AS w FROM kg_edges"),
    "kg_attribute_mass": (("kg_edges",), "SELECT src, round(sum(w) FILTER (dst NOT LIKE 'item=%'), 8) AS mass FROM kg_edges WHERE src LIKE 'item=%' GROUP BY 1"),
    "walk_seeds": (("seed_parts",), "SELECT user_id, vertical, i AS node, round(sum(w * CASE WHEN inside THEN 1.0 ELSE 0.6 END), 8) AS w FROM seed_parts GROUP BY ALL"),
    "score_walk_within": _round("score_walk_within"),
    "score_walk_xvert": _round("score_walk_xvert"),
    "rank_walk_xvert": (("rank_walk_xvert",), "SELECT user_id, target, vertical, rank FROM rank_walk_xvert"),
    "rank_walk_kg": (("rank_walk_kg",), "SELECT user_id, target, vertical, rank FROM rank_walk_kg"),
    "bridge_affinity": (("affinity",), "SELECT a, b, CAST(co AS BIGINT) AS co, round(affinity, 8) AS affinity FROM affinity"),
    "bridge_top_transfers": (("affinity", "items"), """WITH v AS (SELECT category, max(vertical) AS vertical FROM items GROUP BY 1)
        SELECT a, b, x.vertical AS from_vertical, y.vertical AS to_vertical, CAST(co AS BIGINT) AS co, round(affinity, 8) AS affinity FROM affinity JOIN v x ON x.category = a JOIN v y ON y.category = b
        WHERE x.vertical <> y.vertical ORDER BY round(affinity, 10) DESC, a, b LIMIT 12"""),
    "score_bridge": _round("score_bridge"),
    "rank_bridge": (("rank_bridge",), "SELECT user_id, target, vertical, rank FROM rank_bridge"),
    "leaderboard": (("measured_popularity", "measured_knn", "measured_walk_xvert"), " UNION ALL ".join(
        f"SELECT '{label}' AS model, round(avg(ndcg_at_10), 6) AS ndcg_at_10, " + ", ".join(f"round(avg(CASE WHEN {s} THEN ndcg_at_10 END), 6) AS ndcg_at_10_{s}" for s in ("cold_in_vertical", "transfer_only", "tail_target")) + f" FROM measured_{name}"
        for label, name in (("popularity", "popularity"), ("item_knn(k=150)", "knn"), ("graph_walk(xvert,L=3)", "walk_xvert")))),
    "paired_delta": (("paired",), f"SELECT {_SUMMARY}, round(sqrt(greatest((avg(x * x) + avg(y * y)) / 2 - pow((avg(x) + avg(y)) / 2, 2), 0)), 8) AS pooled_sd FROM paired"),
    "paired_delta_by_slice": (("paired",), f"SELECT slice, count(*) AS n, CAST(sum(CASE WHEN x > 0 OR y > 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_informative, round(avg(x - y), 8) AS delta FROM (SELECT *, {_SLICED} FROM paired) GROUP BY slice"),
    "informative_rows": (("paired",), "SELECT user_id, target, vertical, x > 0 OR y > 0 AS informative FROM paired"),
    "power_analysis": (("paired",), """SELECT round(effect, 8) AS effect, round(sd, 8) AS pooled_sd, CASE WHEN effect = 0 OR sd <= 0 THEN -1 ELSE CAST(ceil(2 * pow(1.959963984540054 + 0.8416212335729144, 2) * sd * sd / (effect * effect)) AS BIGINT) END AS required_n_per_arm
        FROM (SELECT avg(x - y) AS effect, sqrt(greatest((avg(x * x) + avg(y * y)) / 2 - pow((avg(x) + avg(y)) / 2, 2), 0)) AS sd FROM paired)"""),
    "percentile_of_ranks": (("rank_popularity",), "SELECT vertical, round(quantile_cont(rank, 0.025), 6) AS low, round(quantile_cont(rank, 0.975), 6) AS high FROM rank_popularity GROUP BY 1"),
    "rowwise_zscore": (("score_knn",), "SELECT user_id, target, vertical, item_id, round((score - avg(score) OVER w) / greatest(stddev_pop(score) OVER w, 1e-8), 6) AS z FROM score_knn WINDOW w AS (PARTITION BY user_id, target, vertical)"),
    "fusion_features": (("score_knn", "pop", "pop_pct", "rows"), """SELECT s.user_id, s.target, s.item_id, row_number() OVER (PARTITION BY s.user_id, s.target, s.vertical ORDER BY round(s.score, 10) DESC, s.item_id) - 1 AS knn_rank, round(ln(1 + p.pop), 8) AS log_pop, round(q.pct, 8) AS pop_pct,
        r.hist_len AS hist_total, r.in_vertical_hist AS hist_in_vertical, r.hist_len - r.in_vertical_hist AS hist_other_verticals, round((r.hist_len - r.in_vertical_hist) / greatest(r.hist_len, 1), 8) AS share_other, r.cold_in_vertical AS cold
        FROM score_knn s JOIN pop p ON p.item_id = s.item_id JOIN pop_pct q ON q.item_id = s.item_id JOIN rows r ON r.user_id = s.user_id AND r.target = s.target"""),
    "rowwise_zscore_full": (("score_knn", "pairs"), """SELECT user_id, target, vertical, item_id, round((score - avg(score) OVER w) / greatest(stddev_pop(score) OVER w, 1e-8), 6) AS z
        FROM (SELECT p.user_id, p.target, p.vertical, p.item_id, coalesce(s.score, 0) AS score FROM pairs p LEFT JOIN score_knn s ON s.user_id = p.user_id AND s.target = p.target AND s.vertical = p.vertical AND s.item_id = p.item_id) WINDOW w AS (PARTITION BY user_id, target, vertical)"""),
    "fusion_features_full": (("score_knn", "pairs", "pop_pct", "rows"), """SELECT p.user_id, p.target, p.item_id, row_number() OVER (PARTITION BY p.user_id, p.target, p.vertical ORDER BY round(coalesce(s.score, 0), 10) DESC, p.item_id) - 1 AS knn_rank, round(coalesce(s.score, 0), 8) AS knn_score, round(ln(1 + p.pop), 8) AS log_pop, round(q.pct, 8) AS pop_pct,
        r.hist_len AS hist_total, r.in_vertical_hist AS hist_in_vertical, r.hist_len - r.in_vertical_hist AS hist_other_verticals, round((r.hist_len - r.in_vertical_hist) / greatest(r.hist_len, 1), 8) AS share_other, r.cold_in_vertical AS cold
        FROM pairs p LEFT JOIN score_knn s ON s.user_id = p.user_id AND s.target = p.target AND s.vertical = p.vertical AND s.item_id = p.item_id JOIN pop_pct q ON q.item_id = p.item_id JOIN rows r ON r.user_id = p.user_id AND r.target = p.target AND r.vertical = p.vertical"""),
    "blend_rank": (("open_pairs", "score_popularity", "score_bridge", "rows"), """WITH joined AS (SELECT p.user_id, p.target, p.vertical, p.item_id, (p.score - avg(p.score) OVER w) / greatest(stddev_pop(p.score) OVER w, 1e-8) AS zb, (s.score - avg(s.score) OVER w) / greatest(stddev_pop(s.score) OVER w, 1e-8) AS za
            FROM score_popularity p JOIN score_bridge s ON s.user_id = p.user_id AND s.target = p.target AND s.item_id = p.item_id WINDOW w AS (PARTITION BY p.user_id, p.target, p.vertical)),
        mixed AS (SELECT b.*, a.alpha, round(a.alpha * za + (1 - a.alpha) * zb, 6) AS score FROM joined b SEMI JOIN open_pairs o ON o.user_id = b.user_id AND o.target = b.target AND o.item_id = b.item_id, (VALUES (CAST(0.25 AS DOUBLE)), (CAST(0.75 AS DOUBLE))) a(alpha))
        SELECT user_id, target, alpha, count(*) FILTER (score >= own) AS rank FROM (SELECT *, max(score) FILTER (item_id = target) OVER (PARTITION BY user_id, target, alpha) AS own FROM mixed) GROUP BY ALL"""),
    "interleaved_slates": (("slates",), "SELECT user_id, target, vertical, item_id, CAST(slot AS INTEGER) AS slot, owner FROM slates"),
    "interleaved_outcomes": (("slates",), "SELECT user_id, target, vertical, coalesce(max(CASE owner WHEN 'a' THEN 1.0 ELSE -1.0 END) FILTER (item_id = target), 0.0)::DOUBLE AS outcome FROM slates GROUP BY ALL"),
    "sampled_negatives": (("dense_knn",), """SELECT user_id, target, vertical, item_id, hard FROM (
        SELECT *, row_number() OVER (PARTITION BY user_id, target, vertical ORDER BY hard, draw, item_id) AS easy FROM (
        SELECT *, best <= 200 AND row_number() OVER (PARTITION BY user_id, target, vertical ORDER BY best > 200, draw, item_id) <= 8 AS hard FROM (
        SELECT *, row_number() OVER (PARTITION BY user_id, target, vertical ORDER BY fused DESC, item_id) AS best, md5(concat_ws('|', user_id, target, vertical, item_id, 0)) AS draw FROM (
        SELECT *, round((score - avg(score) OVER w) / greatest(stddev_pop(score) OVER w, 1e-8), 10) AS fused FROM dense_knn WINDOW w AS (PARTITION BY user_id, target, vertical)) WHERE item_id <> target)))
        WHERE hard OR easy <= 16"""),
    "validation_sample": (("train", "split"), """SELECT user_id, target, vertical, hist_len FROM (
        SELECT s.user_id, s.item_id AS target, s.vertical, h.n AS hist_len, row_number() OVER (PARTITION BY s.vertical ORDER BY md5(concat_ws('|', s.user_id, s.item_id, s.vertical, 0)), s.user_id, s.item_id) AS place
        FROM split s JOIN (SELECT user_id, count(*) AS n FROM train GROUP BY 1) h ON h.user_id = s.user_id WHERE s.part = 'val') WHERE place <= 100"""),
    "bootstrap_replicates": (("replicates",), "SELECT replicate, n, round(delta, 8) AS delta, round(baseline, 8) AS baseline FROM replicates"),
    "bootstrap_interval": (("replicates",), """SELECT count(*) AS n_replicates, round(quantile_cont(delta, 0.025), 8) AS ci_low, round(quantile_cont(delta, 0.975), 8) AS ci_high,
        round(least(1.0, 2 * least(avg(CASE WHEN delta <= 0 THEN 1.0 ELSE 0.0 END), avg(CASE WHEN delta >= 0 THEN 1.0 ELSE 0.0 END))), 8)::DOUBLE AS p_value,
        round(quantile_cont(100 * delta / baseline, 0.025) FILTER (baseline > 0), 5) AS rel_ci_low, round(quantile_cont(100 * delta / baseline, 0.975) FILTER (baseline > 0), 5) AS rel_ci_high,
        quantile_cont(delta, 0.025) > 0 OR quantile_cont(delta, 0.975) < 0 AS significant FROM replicates"""),
    "rating_log": (("ratings",), "SELECT CAST(user_id AS VARCHAR) AS user_id, CAST(item_id AS VARCHAR) AS item_id, vertical, timestamp FROM ratings"),
    "rating_cohort": (("ratings",), """WITH touched AS (SELECT user_id, count(DISTINCT vertical) >= 2 AS several FROM ratings GROUP BY 1),
        placed AS (SELECT *, row_number() OVER (PARTITION BY several ORDER BY md5(concat_ws('|', user_id, 0)), CAST(user_id AS VARCHAR)) AS place FROM touched),
        cohort AS (SELECT * FROM ratings WHERE user_id IN (SELECT user_id FROM placed WHERE place <= CASE WHEN several THEN 60 ELSE 20 END))
        SELECT CAST(user_id AS VARCHAR) AS user_id, CAST(item_id AS VARCHAR) AS item_id, vertical, timestamp FROM cohort WHERE item_id IN (SELECT item_id FROM cohort GROUP BY 1 HAVING count(*) >= 2)"""),
    "split_test_arms": (("arms",), "SELECT treated, n, " + ", ".join(f"round({c}, 8) AS {c}" for c in ("mean_x", "mean_y", "mean_p", "cov_xx", "cov_yy", "cov_pp", "cov_xy", "cov_xp")) + " FROM arms"),
    "split_test_result": (("arm_pair",), """SELECT na AS n_treated, nb AS n_control, round(((na - even) * (na - even) + (nb - even) * (nb - even)) / even, 8) AS chi_square, round(ra, 8) AS ratio_treated, round(rb, 8) AS ratio_control, round(ra - rb, 8) AS lift,
        round(ra - rb - 1.959963984540054 * sqrt(error), 8) AS ci_low, round(ra - rb + 1.959963984540054 * sqrt(error), 8) AS ci_high, abs(ra - rb) > 1.959963984540054 * sqrt(error) AS significant,
        round(dx - theta * dp, 8) AS adjusted_delta, round(sqrt(less), 8) AS adjusted_se, round(1 - less / plain, 8) AS variance_removed FROM arm_pair"""),
    "event_sessions": (("spans",), _SPANS),
    "stream_sessions": (("spans",), _SPANS + " WHERE ended <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)"),
    "daily_popularity": ((), "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type AS vertical, event_type || ':' || json_extract_string(props, '$.k') AS item_id, count(*) AS n FROM events GROUP BY ALL"),
    "sequence_pairs": (("train",), "SELECT user_id, item_id, next_item FROM (SELECT user_id, item_id, lead(item_id) OVER (PARTITION BY user_id ORDER BY ts, session_id, line, item_id) AS next_item FROM train) WHERE next_item IS NOT NULL"),
    "last_n_history": (("train",), """SELECT user_id, string_agg(item_id || '@' || vertical, ' ' ORDER BY back DESC) AS history FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, session_id DESC, line DESC, item_id DESC) AS n FROM train) WHERE n <= 5 GROUP BY 1"""),
    "stream_split": ((), """WITH e AS (SELECT user_id, event_type || ':' || json_extract_string(props, '$.k') AS item_id, event_type AS vertical, ts, event_id FROM events),
        p AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) - 1 AS back FROM e)
        SELECT user_id, item_id, vertical, event_id, CASE WHEN back >= 2 THEN 'train' WHEN item_id NOT IN (SELECT item_id FROM p WHERE back >= 2) THEN NULL WHEN back = 1 THEN 'val' ELSE 'test' END AS part FROM p"""),
}


def oracle_sql() -> dict[str, str]:
    return {name: statement(*query) for name, query in QUERIES.items()}
