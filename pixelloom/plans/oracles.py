"""DuckDB SQL with the same results as the queries, written on its own."""

from __future__ import annotations

from pixelloom.functions import permutation
from pixelloom.operators.pixels import blur_kernel

PIX = """raw AS (SELECT vec_id, label::BIGINT AS label, generate_subscripts(embedding, 1) - 1 AS p, unnest(embedding)::DOUBLE AS x FROM embeddings),
pix AS (SELECT vec_id, label, p::BIGINT AS p, (p // 8)::BIGINT AS r, (p % 8)::BIGINT AS c, floor((x + 1) * 127.5)::BIGINT AS px, x FROM raw)"""


def px(body: str, extra: str = "") -> str:
    return f"WITH {PIX}{', ' + extra if extra else ''} {body}"


def grid(name: str, rows: int, cols: int, a: int, b: int, m: int, s: int, kind: str = "DOUBLE") -> str:
    return f"{name} AS (SELECT o.range::BIGINT AS o, k.range::BIGINT AS k, (((o.range * {a} + k.range * {b}) % {m} - {s})::DOUBLE / 100)::{kind}::DOUBLE AS w FROM range({rows}) o, range({cols}) k)"


def bias(name: str, n: int, a: int, m: int, kind: str = "DOUBLE") -> str:
    return f"{name} AS (SELECT range::BIGINT AS o, (((range * {a}) % {m})::DOUBLE / 100)::{kind}::DOUBLE AS b FROM range({n}))"


def values(name: str, columns: str, rows: list[tuple]) -> str:
    return f"{name}({columns}) AS (VALUES {', '.join(str(tuple(r)) for r in rows)})"


SQL: dict[str, str] = {
    "px_quantize": px("SELECT vec_id, p, px FROM pix"),
    "px_invert": px("SELECT vec_id, p, 255 - px AS px FROM pix"),
    "px_binary_scale": px("SELECT vec_id, p, (CASE WHEN px <= 127 THEN 0 ELSE 255 END)::BIGINT AS px FROM pix"),
    "px_restriction": px("SELECT vec_id, p, px - px % 33 AS px FROM pix"),
    "px_normalize": px("SELECT vec_id, p, round(px / 255.0::DOUBLE, 6) AS v FROM pix"),
    "px_crop": px("SELECT vec_id, ((r - 1) * 4 + c - 2)::BIGINT AS p, px FROM pix WHERE r BETWEEN 1 AND 3 AND c BETWEEN 2 AND 5"),
    "px_pipeline_invert_binary": px("SELECT vec_id, p, (CASE WHEN 255 - px <= 127 THEN 0 ELSE 255 END)::BIGINT AS px FROM pix"),
    "px_histogram": px("SELECT vec_id, px, count(*) AS n FROM pix GROUP BY vec_id, px"),
    "px_histogram_dense": px("SELECT v.vec_id, s.range::BIGINT AS p, coalesce(h.n, 0)::BIGINT AS n FROM (SELECT vec_id FROM embeddings) v CROSS JOIN range(256) s LEFT JOIN h ON h.vec_id = v.vec_id AND h.px = s.range", "h AS (SELECT vec_id, px, count(*) AS n FROM pix GROUP BY vec_id, px)"),
    "px_ratio_histogram": px("SELECT vec_id, px AS p, round(count(*) / 64.0::DOUBLE, 6) AS ratio FROM pix GROUP BY vec_id, px"),
    "px_equalize": px("SELECT vec_id, p, round((count(*) OVER (PARTITION BY vec_id ORDER BY px RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) / 64.0::DOUBLE * 255)::BIGINT AS px FROM pix"),
    "px_binary_by_median": px(
        "SELECT vec_id, p, (CASE WHEN px <= cap THEN 0 ELSE 255 END)::BIGINT AS px FROM pix JOIN m USING (vec_id)",
        "cum AS (SELECT DISTINCT vec_id, px, count(*) OVER (PARTITION BY vec_id ORDER BY px RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS n FROM pix), m AS (SELECT vec_id, coalesce(min(px) FILTER (2 * n >= 64 AND px < 255), 254) AS cap FROM cum GROUP BY vec_id)",
    ),
    "px_sobel_edges": px(
        "SELECT p.vec_id, p.p, (CASE WHEN r BETWEEN 1 AND 6 AND c BETWEEN 1 AND 6 AND abs(gx) + abs(gy) >= 50 THEN 255 ELSE 0 END)::BIGINT AS px FROM pix p JOIN g ON g.vec_id = p.vec_id AND g.y = p.r AND g.x = p.c",
        values("t", "dy, dx, sx, sy", [(dy, dx, dx * (2 - abs(dy)), dy * (2 - abs(dx))) for dy in (-1, 0, 1) for dx in (-1, 0, 1)]) + ", g AS (SELECT vec_id, r - dy AS y, c - dx AS x, sum(px * sx) AS gx, sum(px * sy) AS gy FROM pix, t GROUP BY ALL)",
    ),
    "px_gaussian_oop": px(
        "SELECT p.vec_id, p.p, (CASE WHEN r BETWEEN 2 AND 5 AND c BETWEEN 2 AND 5 THEN floor(s) ELSE 0 END)::BIGINT AS px FROM pix p JOIN g ON g.vec_id = p.vec_id AND g.y = p.r AND g.x = p.c",
        values("t", "dy, dx, w", [(dy - 2, dx - 2, float(blur_kernel(5)[dy, dx])) for dy in range(5) for dx in range(5)]) + ", g AS (SELECT vec_id, r - dy AS y, c - dx AS x, sum(px * w::DOUBLE) AS s FROM pix, t GROUP BY ALL)",
    ),
    "px_resize": px(
        """SELECT vec_id, (y * 5 + x)::BIGINT AS p, (CASE WHEN x IN (0, 4) OR y IN (0, 4) THEN e.px ELSE floor(v + 0.5) END)::BIGINT AS px FROM b JOIN (SELECT vec_id, r, c, px FROM pix) e USING (vec_id) WHERE e.r = ey AND e.c = ex""",
        """d AS (SELECT y.range AS y, x.range AS x, x.range * (7 / 4.0::DOUBLE) AS sx, y.range * (7 / 4.0::DOUBLE) AS sy FROM range(5) y, range(5) x),
        q AS (SELECT *, sx - floor(sx) AS ax, sy - floor(sy) AS ay, CASE WHEN x = 4 THEN 7 ELSE floor(sx + 0.5) END AS ex, CASE WHEN y = 4 THEN 7 ELSE floor(sy + 0.5) END AS ey FROM d),
        b AS (SELECT vec_id, y, x, ex, ey, sum(px * CASE WHEN r = floor(sy) AND r = ceil(sy) THEN 1 WHEN r = floor(sy) THEN 1 - ay ELSE ay END * CASE WHEN c = floor(sx) AND c = ceil(sx) THEN 1 WHEN c = floor(sx) THEN 1 - ax ELSE ax END) AS v
            FROM q JOIN (SELECT vec_id, r, c, px FROM pix) k ON r IN (floor(sy), ceil(sy)) AND c IN (floor(sx), ceil(sx)) GROUP BY ALL)""",
    ),
    "px_difference": px("SELECT a.vec_id, round(sum(abs(a.px - b.px)) / 255.0::DOUBLE, 6) AS difference FROM pix a JOIN pix b ON b.vec_id = a.vec_id + 1 AND a.p = b.p GROUP BY a.vec_id"),
    "px_pixel_at": px("SELECT vec_id, px FROM pix WHERE r = 5 AND c = 3"),
    "px_sizes": "SELECT vec_id, 8::INTEGER AS width, 8::INTEGER AS height, 64::BIGINT AS n_pixels FROM embeddings",
    "px_printed": px("SELECT vec_id, string_agg(line || chr(10), '' ORDER BY r) AS text FROM (SELECT vec_id, r, string_agg(px::VARCHAR, ' ' ORDER BY c) AS line FROM pix GROUP BY vec_id, r) GROUP BY vec_id"),
    "luma_rgb": px("SELECT vec_id, p // 3 AS p, ((sum(px * CASE p % 3 WHEN 0 THEN 77 WHEN 1 THEN 150 ELSE 29 END)) // 256)::BIGINT AS gray FROM pix WHERE p < 63 GROUP BY vec_id, p // 3"),
    "px_set_size": "SELECT vec_id, range::BIGINT AS p, 0::BIGINT AS px FROM embeddings, range(12)",
    "img_write_and_load": px("SELECT vec_id, 'class' || label AS class_name, 8::INTEGER AS width, 8::INTEGER AS height, p, px FROM pix"),
    "img_noise": "SELECT c.range::BIGINT AS vec_id, k.range::BIGINT AS p, ('0x' || substr(md5('5:' || c.range || ':' || k.range), 1, 2))::BIGINT AS px FROM range((SELECT count(*) FROM customer)) c, range(6) k",
}

KINDS = "kinds AS (SELECT event_type, row_number() OVER (ORDER BY event_type) - 1 AS class_id FROM (SELECT DISTINCT event_type FROM events))"
PLACED = "e AS (SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS pos FROM events)"
TENSORS = f"{PLACED}, t AS (SELECT DISTINCT pos // 256 AS tensor FROM e), n AS (SELECT tensor, ntile(3) OVER (ORDER BY tensor) - 1 AS part FROM t)"
SQL |= {
    "ds_class_dictionary": f"WITH {KINDS} SELECT class_id, event_type AS class_name FROM kinds",
    "ds_class_counts": f"WITH {KINDS} SELECT class_id, count(*) AS n FROM events JOIN kinds USING (event_type) GROUP BY class_id",
    "ds_class_cap": f"WITH {KINDS} SELECT event_id, class_id FROM (SELECT event_id, class_id, row_number() OVER (PARTITION BY class_id ORDER BY event_id) AS n FROM events JOIN kinds USING (event_type)) WHERE n <= 100",
    "ds_tensor_batches": f"WITH {PLACED} SELECT event_id, pos, pos // 256 AS tensor_id FROM e",
    "ds_rebatch": f"WITH {PLACED} SELECT event_id, pos // 100 AS tensor_id FROM e",
    "ds_remove_tensors": f"WITH {PLACED} SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS pos, CASE WHEN pos >= 768 THEN pos // 256 - 2 ELSE pos // 256 END AS tensor_id FROM e WHERE pos < 256 OR pos >= 768",
    "ds_minibatch_ids": f"WITH {PLACED} SELECT event_id, pos // 16 AS batch_id, pos % 16 AS in_batch FROM e",
    "ds_split_parts": f"WITH {TENSORS} SELECT event_id, part::BIGINT AS part FROM e JOIN n ON pos // 256 = tensor",
    "ds_split_sizes": f"WITH {TENSORS} SELECT part::BIGINT AS part, count(*) AS n FROM e JOIN n ON pos // 256 = tensor GROUP BY part",
    "ds_append": "WITH e AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS pos, count(*) OVER () AS n FROM embeddings) SELECT vec_id AS sample_id, pos FROM e UNION ALL SELECT vec_id + 1000000, pos + n FROM e",
    "ds_onehot": "SELECT vec_id, range::BIGINT AS p, (CASE WHEN range = label THEN 1 ELSE 0 END)::DOUBLE AS v FROM embeddings, range(10)",
    "ds_train_eval": "SELECT CASE WHEN vec_id % 5 = 0 THEN 'eval' ELSE 'train' END AS split, label::BIGINT AS class_id, count(*) AS n FROM embeddings GROUP BY ALL",
    "ds_shuffle": "SELECT vec_id AS sample_id, pos, pos // 32 AS tensor_id FROM (SELECT vec_id, row_number() OVER (ORDER BY ((vec_id + 7) * 1103515245 + 12345) % 2147483648, vec_id) - 1 AS pos FROM embeddings)",
    "ds_relabel": "SELECT vec_id AS sample_id, (CASE WHEN label = 3 THEN 7 ELSE label END)::BIGINT AS class_id FROM embeddings",
    "la_sum": px("SELECT vec_id, round(sum(x), 6) AS v FROM pix GROUP BY vec_id"),
    "la_asum": px("SELECT vec_id, round(sum(abs(x)), 6) AS v FROM pix GROUP BY vec_id"),
    "la_l2norm": px("SELECT vec_id, round(sqrt(sum(x * x)), 6) AS v FROM pix GROUP BY vec_id"),
    "la_imax_abs": px("SELECT vec_id, p AS v FROM pix QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY abs(x) DESC, p) = 1"),
    "la_imax": px("SELECT vec_id, p AS v FROM pix QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY x DESC, p) = 1"),
    "la_scale": px("SELECT vec_id, p, round(x * 2.5, 6) AS v FROM pix"),
    "la_transpose": px("SELECT vec_id, c * 8 + r AS p, round(x, 6) AS v FROM pix"),
    "la_gemm_rows": px("SELECT a.vec_id, a.r * 8 + b.r AS p, round(sum(a.x * b.x) * 2, 6) AS v FROM pix a JOIN pix b ON a.vec_id = b.vec_id AND a.c = b.c GROUP BY a.vec_id, a.r, b.r"),
    "ts_batched_gemm_tt": px("SELECT a.vec_id, a.r * 8 + b.c AS p, round(sum(a.x * b.x), 6) AS v FROM pix a JOIN pix b ON a.vec_id = b.vec_id AND a.c = b.r GROUP BY a.vec_id, a.r, b.c"),
    "ts_batched_gemm_mt": px("SELECT vec_id, o AS i, c AS j, round(sum(w * x), 6) AS v FROM m JOIN pix ON k = r GROUP BY ALL", grid("m", 8, 8, 7, 3, 19, 9)),
    "ts_batched_gemm_bias": px(
        "SELECT vec_id, i, j, round(sum(v), 6) AS v FROM (SELECT vec_id, o AS i, c AS j, w * x AS v FROM m JOIN pix ON k = r WHERE k < 4 AND (vec_id % 7 <> 0 OR r >= 4) UNION ALL SELECT vec_id, o, k, 0.5 * w FROM embeddings, cc) GROUP BY vec_id, i, j",
        grid("m", 8, 8, 7, 3, 19, 9) + ", " + grid("cc", 8, 8, 5, 11, 23, 11),
    ),
    "ts_slice_of": "SELECT vec_id AS sample_id, pos - n // 3 - least(n % 3, 1) AS pos FROM (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS pos, count(*) OVER () AS n FROM embeddings) WHERE pos >= n // 3 + least(n % 3, 1) AND pos < 2 * (n // 3) + least(n % 3, 2)",
    "la_gram": px("SELECT a.p AS i, b.p AS j, round(sum(a.x * b.x), 4) AS v FROM pix a JOIN pix b USING (vec_id) GROUP BY a.p, b.p"),
    "la_gram_tiled": px("SELECT a.p AS i, b.p AS j, round(sum(a.x * b.x), 4) AS v FROM pix a JOIN pix b USING (vec_id) GROUP BY a.p, b.p"),
    "la_filled": "SELECT vec_id, range::BIGINT AS p, 1.5::DOUBLE AS v FROM embeddings, range(6)",
    "la_random": "SELECT vec_id, range::BIGINT AS p, round(('0x' || substr(md5('3:' || vec_id || ':' || range), 1, 8))::BIGINT / 4294967296.0::DOUBLE * 2 - 1, 6) AS v FROM embeddings, range(20)",
    "la_random_padded": "SELECT vec_id, range::BIGINT AS p, CASE WHEN range // 5 BETWEEN 1 AND 2 AND range % 5 BETWEEN 1 AND 3 THEN round(('0x' || substr(md5('4:' || vec_id || ':' || range), 1, 8))::BIGINT / 4294967296.0::DOUBLE * 1.5 + 0.5, 6) ELSE 0 END::DOUBLE AS v FROM embeddings, range(20)",
    "ts_sum_collapse": px("SELECT r AS i, c AS j, round(sum(x), 6) AS v FROM pix GROUP BY r, c"),
    "ts_slice": "SELECT vec_id AS sample_id, pos - 100 AS pos FROM (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS pos FROM embeddings) WHERE pos >= 100 AND pos < 150",
    "ts_reshape": px("SELECT vec_id, p // 16 AS i, p % 16 AS j, round(x, 6) AS v FROM pix"),
    "ts_tensor_sum": px("SELECT a.vec_id, a.r AS i, a.c AS j, round(a.x + 0.5 * coalesce(b.x, 0), 6) AS v FROM pix a LEFT JOIN pix b ON b.vec_id = a.vec_id + 1 AND a.p = b.p"),
}
for _name, _formula in {"la_add": "a.x + b.x", "la_sub": "a.x - b.x", "la_axpy": "a.x - 0.75 * b.x", "la_hadamard": "a.x * b.x"}.items():
    SQL[_name] = px(f"SELECT a.vec_id, a.p, round({_formula}, 6) AS v FROM pix a JOIN pix b ON a.vec_id = b.vec_id AND a.r = b.c AND a.c = b.r")

TIMES = "g AS (SELECT vec_id AS i, b.k AS j, sum(x * b.w) AS s FROM pix JOIN b ON p = b.o GROUP BY ALL)"
FIXED = grid("b", 64, 40, 5, 11, 23, 11)
SQL |= {
    "la_gemm": px("SELECT i, j, round(s, 6) AS v FROM g", f"{FIXED}, {TIMES}"),
    "la_gemm_ta": px("SELECT p AS i, label AS j, round(2 * sum(x), 4) AS v FROM pix GROUP BY p, label"),
    "la_gemm_tb": px("SELECT vec_id AS i, o AS j, round(sum(x * w), 6) AS v FROM pix JOIN a ON p = k GROUP BY vec_id, o", grid("a", 40, 64, 7, 3, 19, 9)),
    "la_gemm_bias": px("SELECT i, j, round(s * 0.5 + 3 * x, 6) AS v FROM g JOIN pix ON i = vec_id AND j = p", f"{FIXED}, {TIMES}"),
    "la_gemm_tiled": px("SELECT i, j, v FROM (SELECT i, j, round(s, 6) AS v FROM g) WHERE v <> 0", f"{FIXED}, {TIMES}"),
}

SIGMOID = "(1 / (1 + exp(-x)))"
for _name, _formula in {
    "identity": "x",
    "identity_derivative": "1.0::DOUBLE",
    "sigmoid": SIGMOID,
    "sigmoid_derivative": f"{SIGMOID} * (1 - {SIGMOID})",
    "relu": "greatest(x, 0)",
    "relu_derivative": "CASE WHEN x > 0 THEN 1.0::DOUBLE ELSE 0 END",
    "leaky_relu": "CASE WHEN x > 0 THEN x ELSE 0.01 * x END",
    "leaky_relu_derivative": "CASE WHEN x > 0 THEN 1.0::DOUBLE ELSE 0.01 END",
    "square": "x * x",
    "square_derivative": "2 * x",
}.items():
    SQL[f"af_{_name}"] = px(f"SELECT vec_id, p, round(({_formula})::DOUBLE, 6) AS v FROM pix")

#: The perceptron, and as its file holds it, in 32 bits.
MODEL, MODEL_FILE = (", ".join([grid("w1", 8, 64, 7, 3, 19, 9, kind), grid("w2", 10, 8, 5, 11, 23, 11, kind), bias("b1", 8, 3, 7, kind), bias("b2", 10, 5, 11, kind)]) for kind in ("DOUBLE", "FLOAT"))


def forward(w1: str, w2: str, n: str = "") -> str:
    return f"""z1{n} AS (SELECT vec_id, o, 1 / (1 + exp(-(sum(x * w) + any_value(b)))) AS a FROM pix JOIN {w1} ON p = k JOIN b1 USING (o) GROUP BY vec_id, o),
    z2{n} AS (SELECT vec_id, w.o, 1 / (1 + exp(-(sum(a * w) + any_value(b)))) AS a FROM z1{n} z JOIN {w2} w ON z.o = w.k JOIN b2 ON b2.o = w.o GROUP BY vec_id, w.o)"""


def step(n: int, w1: str, w2: str) -> str:
    """Gradients h1, h2 of full-batch descent, numbered n."""
    return f"""{forward(w1, w2, str(n))},
    d2{n} AS (SELECT vec_id, o, (a - CASE WHEN o = label THEN 1 ELSE 0 END) * a * (1 - a) AS d FROM z2{n} JOIN embeddings USING (vec_id)),
    e1{n} AS (SELECT vec_id, w.k AS o, sum(d * w) AS e FROM d2{n} d JOIN {w2} w ON d.o = w.o GROUP BY vec_id, w.k),
    d1{n} AS (SELECT vec_id, o, e * a * (1 - a) AS d FROM e1{n} JOIN z1{n} USING (vec_id, o)),
    h2{n} AS (SELECT d.o, z.o AS k, sum(d * a) / (SELECT count(*) FROM embeddings) AS g FROM d2{n} d JOIN z1{n} z USING (vec_id) GROUP BY d.o, z.o),
    h1{n} AS (SELECT o, p AS k, sum(d * x) / (SELECT count(*) FROM embeddings) AS g FROM d1{n} JOIN pix USING (vec_id) GROUP BY o, p)"""


def trained(*moves: str) -> str:
    """moves[i]: what step i + 1 takes off a weight, with its gradient h.g and, from the second on, the last move v."""
    ctes, w = [], {1: "w1", 2: "w2"}
    for i, move in enumerate(moves, 1):
        ctes.append(step(i, w[1], w[2]))
        for layer in (1, 2):
            last = f"JOIN m{layer}{i - 1} m USING (o, k)" if i > 1 else ""
            ctes.append(f"m{layer}{i} AS (SELECT o, k, {move} AS v FROM h{layer}{i} h {last})")
            ctes.append(f"w{layer}{i}x AS (SELECT o, k, w - v AS w FROM {w[layer]} JOIN m{layer}{i} USING (o, k))")
            w[layer] = f"w{layer}{i}x"
    return f"WITH {PIX}, {MODEL}, {', '.join(ctes)} SELECT 0::BIGINT AS layer, o, k, round(w, 6) AS w FROM {w[1]} UNION ALL SELECT 1, o, k, round(w, 6) AS w FROM {w[2]}"


def minibatches(steps: int, batches: int) -> str:
    """CTEs of descent by 0.5 with momentum 0.9: step s takes the places of batch s - 1 modulo batches; weights w1s, w2s."""
    ctes = [f"placed AS MATERIALIZED (SELECT vec_id, label, (row_number() OVER (ORDER BY vec_id) - 1) // ceil(count(*) OVER () / {batches}.0)::BIGINT AS batch FROM embeddings)"]
    ctes.append("w10 AS (SELECT o, k, w FROM w1), w20 AS (SELECT o, k, w FROM w2)")
    for s in range(1, steps + 1):
        a, b, n = f"w1{s - 1}", f"w2{s - 1}", f"(SELECT count(*) FROM placed WHERE batch = {(s - 1) % batches})"
        last = lambda layer, s=s: f" + 0.9 * m.v AS v FROM h JOIN m{layer}{s - 1} m USING (o, k)" if s > 1 else " AS v FROM h"
        ctes.append(f"""in{s} AS MATERIALIZED (SELECT vec_id, p, x FROM pix JOIN placed USING (vec_id) WHERE batch = {(s - 1) % batches}),
        za{s} AS MATERIALIZED (SELECT vec_id, o, 1 / (1 + exp(-(sum(x * w) + any_value(b)))) AS a FROM in{s} JOIN {a} ON p = k JOIN b1 USING (o) GROUP BY vec_id, o),
        zb{s} AS MATERIALIZED (SELECT vec_id, w.o, 1 / (1 + exp(-(sum(a * w) + any_value(b)))) AS a FROM za{s} z JOIN {b} w ON z.o = w.k JOIN b2 ON b2.o = w.o GROUP BY vec_id, w.o),
        db{s} AS MATERIALIZED (SELECT vec_id, o, (a - CASE WHEN o = label THEN 1 ELSE 0 END) * a * (1 - a) AS d FROM zb{s} JOIN placed USING (vec_id)),
        da{s} AS MATERIALIZED (SELECT vec_id, o, e * a * (1 - a) AS d FROM (SELECT vec_id, w.k AS o, sum(d * w) AS e FROM db{s} d JOIN {b} w ON d.o = w.o GROUP BY vec_id, w.k) JOIN za{s} USING (vec_id, o)),
        m2{s} AS MATERIALIZED (WITH h AS (SELECT d.o, z.o AS k, sum(d * a) / {n} AS g FROM db{s} d JOIN za{s} z USING (vec_id) GROUP BY d.o, z.o) SELECT o, k, 0.5 * h.g{last(2)}),
        m1{s} AS MATERIALIZED (WITH h AS (SELECT o, p AS k, sum(d * x) / {n} AS g FROM da{s} JOIN in{s} USING (vec_id) GROUP BY o, p) SELECT o, k, 0.5 * h.g{last(1)}),
        w1{s} AS MATERIALIZED (SELECT o, k, w - v AS w FROM {a} JOIN m1{s} USING (o, k)), w2{s} AS MATERIALIZED (SELECT o, k, w - v AS w FROM {b} JOIN m2{s} USING (o, k))""")
    return ", ".join(ctes)


SCORED = f"WITH {PIX}, {MODEL}, {forward('w1', 'w2')}"
PICKED = f"{SCORED}, pairs AS (SELECT o AS pred, label::BIGINT AS truth, vec_id FROM z2 JOIN embeddings USING (vec_id) QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY abs(a) DESC, o) = 1)"
RATED = """s AS (SELECT range::BIGINT AS class_id FROM range({n})),
    k AS (SELECT class_id, (SELECT count(*) FROM pairs WHERE pred = class_id AND truth = class_id) AS tp, (SELECT count(*) FROM pairs WHERE pred = class_id) AS predicted, (SELECT count(*) FROM pairs WHERE truth = class_id) AS actual FROM s),
    q AS (SELECT *, CASE WHEN predicted = 0 THEN 0 ELSE tp / predicted::DOUBLE END AS precision, CASE WHEN actual = 0 THEN 0 ELSE tp / actual::DOUBLE END AS recall FROM k),
    f AS (SELECT *, CASE WHEN precision = 0 OR recall = 0 THEN 0 ELSE 2 * precision * recall / (precision + recall) END AS f1 FROM q)"""
BY_CLASS = "SELECT class_id, tp, predicted, actual, round(precision, 6)::DOUBLE AS precision, round(recall, 6)::DOUBLE AS recall, round(f1, 6)::DOUBLE AS f1 FROM f"
BATCHED = f"WITH {PIX}, {MODEL}, {minibatches(6, 3)}"


def rated(epoch: int, w1: str, w2: str) -> str:
    """Ratings (epoch, class_id, precision, recall, f1) of a model's choices, with their mean."""
    pairs = f"""{forward(w1, w2, "r")}, pairs AS (SELECT o AS pred, label::BIGINT AS truth FROM z2r JOIN embeddings USING (vec_id) QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY abs(a) DESC, o) = 1), {RATED.format(n=10)}"""
    return f"""SELECT * FROM (WITH {pairs} SELECT {epoch}::BIGINT AS epoch, class_id, round(precision, 6)::DOUBLE AS precision, round(recall, 6)::DOUBLE AS recall, round(f1, 6)::DOUBLE AS f1 FROM f
        UNION ALL SELECT {epoch}, NULL, round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6) FROM f)"""


LABELLED = f"WITH pairs AS (SELECT quality::BIGINT AS pred, toxic::BIGINT AS truth FROM labels), {RATED.format(n=2)}, e AS (SELECT class_id, precision, recall, f1 FROM f UNION ALL SELECT NULL, avg(precision), avg(recall), avg(f1) FROM f)"
SQL |= {
    "mlp_train_epochs": f"{BATCHED} {rated(0, 'w13', 'w23')} UNION ALL {rated(1, 'w16', 'w26')}",
    "mlp_minibatch_weights": f"{BATCHED} SELECT 0::BIGINT AS layer, o, k, round(w, 6) AS w FROM w16 UNION ALL SELECT 1, o, k, round(w, 6) AS w FROM w26",
    "mlp_model_file": f"WITH {PIX}, {MODEL_FILE}, {forward('w1', 'w2')} SELECT vec_id, o AS p, round(a, 6) AS v FROM z2",
    "ev_evolution": f"{LABELLED} SELECT 4::BIGINT AS epoch, split, class_id, round(precision, 6)::DOUBLE AS precision, round(recall, 6)::DOUBLE AS recall, round(f1, 6)::DOUBLE AS f1 FROM e, (VALUES ('eval'), ('train')) s(split)",
    "mlp_predict_2layer": f"{SCORED} SELECT vec_id, o AS p, round(a, 6) AS v FROM z2",
    "mlp_predict_blocks": f"{SCORED} SELECT vec_id, o AS p, round(a, 6) AS v FROM z2",
    "mlp_classify": f"{PICKED} SELECT vec_id, pred FROM pairs",
    "mlp_sgd_step": trained("0.5 * h.g"),
    "mlp_momentum_step": trained("0.5 * h.g", "0.5 * h.g + 0.9 * m.v"),
    "mlp_decay_step": trained("0.5 * h.g", "0.5 / 1.5 * h.g"),
    "mlp_decay_momentum_step": trained("0.5 * h.g", "0.5 / 1.5 * h.g + 0.9 * m.v"),
    "ev_confusion": "SELECT quality::BIGINT AS pred, toxic::BIGINT AS truth, count(*) AS n FROM labels GROUP BY ALL",
    "ev_confusion_dense": f"{PICKED} SELECT a.range::BIGINT AS pred, b.range::BIGINT AS truth, (SELECT count(*) FROM pairs WHERE pred = a.range AND truth = b.range) AS n FROM range(10) a, range(10) b",
    "ev_precision_recall_f1": f"{PICKED}, {RATED.format(n=10)} {BY_CLASS}",
    "ev_macro": f"WITH pairs AS (SELECT quality::BIGINT AS pred, toxic::BIGINT AS truth FROM labels), {RATED.format(n=2)} SELECT round(avg(precision), 6) AS precision, round(avg(recall), 6) AS recall, round(avg(f1), 6) AS f1 FROM f",
    "feat_score_lineitem": """WITH s AS (SELECT l_returnflag, abs(l_quantity * 0.01::DOUBLE + l_extendedprice * -0.00001::DOUBLE + l_discount * 3 + l_tax * -2) AS a, abs(l_quantity * -0.02::DOUBLE + l_extendedprice * 0.00002::DOUBLE + l_discount * -1 + l_tax * 4) AS b,
        abs(l_quantity * 0.015::DOUBLE + l_extendedprice * -0.00001::DOUBLE + l_discount * -2 + l_tax) AS c FROM lineitem)
        SELECT (CASE WHEN a >= b AND a >= c THEN 0 WHEN b >= c THEN 1 ELSE 2 END)::BIGINT AS pred, (CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END)::BIGINT AS truth, count(*) AS n FROM s GROUP BY ALL""",
    "template_classifier": px(
        BY_CLASS,
        f"""prep AS (SELECT vec_id, label, p, (CASE WHEN 255 - px <= 127 THEN 0 ELSE 1 END)::BIGINT AS v FROM pix),
        w AS (SELECT label AS class_id, p, floor(sum(v) * 1000 / count(*)::DOUBLE)::BIGINT AS w FROM prep GROUP BY label, p),
        sc AS (SELECT vec_id, label, class_id, sum(v * w)::BIGINT AS s FROM prep JOIN w USING (p) GROUP BY vec_id, label, class_id),
        pairs AS (SELECT class_id AS pred, label AS truth FROM sc QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, class_id) = 1), {RATED.format(n=10)}""",
    ),
}

SOBEL = [(0, 0, 1), (0, 2, -1), (1, 0, 2), (1, 1, 1), (1, 2, -2), (2, 0, 1), (2, 2, -1)]
#: layer, branch, filter, i, j, w
FILTERS = [(0, 0, 0, 0, 0, 1), (0, 0, 0, 0, 1, 2), (0, 0, 0, 1, 1, -1), (0, 0, 1, 0, 0, 2), (0, 0, 1, 0, 1, -1), (0, 0, 1, 1, 0, 1)]
FILTERS += [(1, 0, 0, 0, 0, 1), (1, 0, 0, 1, 1, 1), (1, 0, 1, 0, 1, 1), (1, 0, 1, 1, 0, -1), (1, 0, 1, 1, 1, 1)]
FILTERS += [(1, 1, 0, 0, 0, 1), (1, 1, 0, 0, 1, 1), (1, 1, 0, 1, 0, -1), (1, 1, 1, 0, 0, 2), (1, 1, 1, 1, 1, -1)]
CONV2 = (
    values("t", "layer, branch, f, i, j, w", FILTERS)
    + """, c1 AS (SELECT vec_id, f AS b, r - i AS y, c - j AS x, greatest(sum(px * w), 0) AS v FROM pix, t WHERE layer = 0 AND r - i BETWEEN 0 AND 6 AND c - j BETWEEN 0 AND 6 GROUP BY ALL),
    c2 AS (SELECT vec_id, b * 2 + f AS b, y - i AS y, x - j AS x, greatest(sum(v * w), 0) AS v FROM c1 JOIN t ON layer = 1 AND branch = b WHERE y - i BETWEEN 0 AND 5 AND x - j BETWEEN 0 AND 5 GROUP BY vec_id, b * 2 + f, y - i, x - j)"""
)
WINDOW = "q AS (SELECT a.range AS i, b.range AS j FROM range(2) a, range(2) b)"
SQL |= {
    "cnn_conv_valid": px("SELECT vec_id, ((r - i) * 6 + c - j)::BIGINT AS p, sum(px * w)::DOUBLE AS v FROM pix, t WHERE r - i BETWEEN 0 AND 5 AND c - j BETWEEN 0 AND 5 GROUP BY ALL", values("t", "i, j, w", SOBEL)),
    "cnn_conv_grouped": px("SELECT vec_id, b::BIGINT AS f, (y * 6 + x)::BIGINT AS p, v::DOUBLE AS v FROM c2", CONV2),
    "cnn_predict": px("SELECT vec_id, (b * 25 + (y - i) * 5 + x - j)::BIGINT AS p, max(v)::DOUBLE AS v FROM c2, q WHERE y - i BETWEEN 0 AND 4 AND x - j BETWEEN 0 AND 4 GROUP BY ALL", f"{CONV2}, {WINDOW}"),
    "cnn_model_files": px("SELECT vec_id, (b * 25 + (y - i) * 5 + x - j)::BIGINT AS p, max(v)::DOUBLE AS v FROM c2, q WHERE y - i BETWEEN 0 AND 4 AND x - j BETWEEN 0 AND 4 GROUP BY ALL", f"{CONV2}, {WINDOW}"),
    "cnn_split_features": px("SELECT vec_id, b::BIGINT AS f, ((y - i) * 5 + x - j)::BIGINT AS p, max(v)::DOUBLE AS v FROM c2, q WHERE y - i BETWEEN 0 AND 4 AND x - j BETWEEN 0 AND 4 GROUP BY ALL", f"{CONV2}, {WINDOW}"),
    "cnn_max_pool": px("SELECT vec_id, ((r - i) * 7 + c - j)::BIGINT AS p, max(px)::DOUBLE AS v FROM pix, q WHERE r - i BETWEEN 0 AND 6 AND c - j BETWEEN 0 AND 6 GROUP BY ALL", WINDOW),
    "cnn_avg_pool": px("SELECT vec_id, ((r - i) * 7 + c - j)::BIGINT AS p, sum(px) / 4.0::DOUBLE AS v FROM pix, q WHERE r - i BETWEEN 0 AND 6 AND c - j BETWEEN 0 AND 6 GROUP BY ALL", WINDOW),
    "cnn_avg_pool_backward": px("SELECT vec_id, ((p // 7 + i) * 8 + p % 7 + j)::BIGINT AS p, sum(px) / 4.0::DOUBLE AS v FROM pix, q WHERE p < 49 GROUP BY vec_id, (p // 7 + i) * 8 + p % 7 + j", WINDOW),
    "cnn_max_pool_backward": px(
        "SELECT a.vec_id, a.p, coalesce(sum(e.px), 0)::DOUBLE AS v FROM pix a LEFT JOIN best ON best.vec_id = a.vec_id AND best.at = a.p LEFT JOIN pix e ON e.vec_id = a.vec_id AND e.p = best.o GROUP BY a.vec_id, a.p",
        f"{WINDOW}, best AS (SELECT vec_id, (r - i) * 7 + c - j AS o, p AS at FROM pix, q WHERE r - i BETWEEN 0 AND 6 AND c - j BETWEEN 0 AND 6 QUALIFY row_number() OVER (PARTITION BY vec_id, (r - i) * 7 + c - j ORDER BY px DESC, p) = 1)",
    ),
    "cnn_input_error": px("SELECT vec_id, ((p // 6 + i) * 8 + p % 6 + j)::BIGINT AS p, sum(px * w)::DOUBLE AS v FROM pix, t WHERE p < 36 GROUP BY vec_id, (p // 6 + i) * 8 + p % 6 + j", values("t", "i, j, w", SOBEL + [(0, 1, 0), (2, 1, 0)])),
    "cnn_train_filters": px(
        "SELECT t.i::BIGINT AS i, t.j::BIGINT AS j, round(t.w - 1e-3 * sum(err.e * h.v * pix.px) / (SELECT count(*) FROM embeddings), 6) AS w FROM t, h, pix, err WHERE err.vec_id = pix.vec_id AND pix.r = h.p // 6 + t.i AND pix.c = h.p % 6 + t.j GROUP BY t.i, t.j, t.w",
        values("t", "i, j, w", SOBEL + [(0, 1, 0), (2, 1, 0)])
        + ", h AS (SELECT p, (p * 3 % 19 - 9) / 100.0::DOUBLE AS v FROM range(36) x(p))"
        + ", err AS (SELECT vec_id, sum(px * t.w * h.v) - vec_id % 2 AS e FROM pix, t, h WHERE pix.r = h.p // 6 + t.i AND pix.c = h.p % 6 + t.j GROUP BY vec_id)",
    ),
    "cnn_filter_gradient": px(
        "SELECT ((a.r - e.p // 6) * 3 + a.c - e.p % 6)::BIGINT AS p, round(sum(a.px * e.px) / (SELECT count(*) FROM embeddings)::DOUBLE, 6) AS v FROM pix a JOIN pix e ON a.vec_id = e.vec_id AND e.p < 36 AND a.r - e.p // 6 BETWEEN 0 AND 2 AND a.c - e.p % 6 BETWEEN 0 AND 2 GROUP BY ALL"
    ),
}

KEYS = values("keys", "i, k", list(enumerate(permutation.keys(7))))
MIX = f"((({{0}} + k) * ({{0}} + k)) % {permutation.MODULUS} * {permutation.FACTOR} + k) % {permutation.MODULUS}"
SQL["ds_permuted"] = f"""
WITH RECURSIVE {KEYS}, size AS (SELECT n, a, ((n + a - 1) // a)::BIGINT AS b FROM (SELECT count(*) AS n, ceil(sqrt(count(*)))::BIGINT AS a FROM embeddings)),
walk AS (SELECT vec_id, (pos // b)::BIGINT AS l, (pos % b)::BIGINT AS r, 0 AS step FROM (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS pos FROM embeddings), size
    UNION ALL SELECT vec_id, CASE WHEN i % 2 = 0 THEN (l + {MIX.format("r")}) % a ELSE l END, CASE WHEN i % 2 = 1 THEN (r + {MIX.format("l")}) % b ELSE r END, step + 1
    FROM walk JOIN keys ON i = step % {permutation.ROUNDS}, size WHERE step = 0 OR step % {permutation.ROUNDS} > 0 OR l * b + r >= n)
SELECT vec_id AS sample_id, (l * b + r)::BIGINT AS pos, ((l * b + r) // 32)::BIGINT AS tensor_id FROM walk, size WHERE step > 0 AND step % {permutation.ROUNDS} = 0 AND l * b + r < n"""

SQL["px_transforms_from_file"] = SQL["px_resize_pipeline"] = SQL["px_transforms_from_text"] = SQL["px_pipeline_invert_binary"]
SQL["img_directory"] = SQL["px_quantize"]
SQL["px_edges_blocks"] = SQL["px_sobel_edges"]


def tall(seen: str, value: str, half: int) -> str:
    """The embeddings as lines of one image: `value` over the neighbours (dy, dx, w) of `seen`, 0 near the border."""
    inner = f"gy BETWEEN {half} AND n - {half + 1} AND gx BETWEEN {half} AND {63 - half}"
    return f"""WITH {PIX}, {seen}, h AS (SELECT max(vec_id) + 1 AS n FROM embeddings), g AS (SELECT vec_id - dy AS gy, p - dx AS gx, {value} AS v FROM pix, t GROUP BY ALL)
    SELECT vec_id AS y, p AS x, (CASE WHEN {inner} THEN g.v ELSE 0 END)::BIGINT AS px FROM h, pix JOIN g ON gy = vec_id AND gx = p"""


SQL["px_gaussian_tiled"] = tall(values("t", "dy, dx, w", [(dy - 5, dx - 5, float(blur_kernel()[dy, dx])) for dy in range(11) for dx in range(11)]), "floor(sum(px * w::DOUBLE))", 5)
SQL["px_edges_tiled"] = tall(values("t", "dy, dx, sx, sy", [(dy, dx, dx * (2 - abs(dy)), dy * (2 - abs(dx))) for dy in (-1, 0, 1) for dx in (-1, 0, 1)]), "CASE WHEN abs(sum(px * sx)) + abs(sum(px * sy)) >= 50 THEN 255 ELSE 0 END", 1)
SQL |= {
    "img_info": "SELECT vec_id, 8::INTEGER AS width, 8::INTEGER AS height, 1::INTEGER AS channels FROM embeddings",
    "img_without_classes": px("SELECT vec_id, row_number() OVER (ORDER BY 'class' || any_value(label) || '/' || vec_id || '.png') - 1 AS place, -1::BIGINT AS class_id, max(px) AS brightest FROM pix GROUP BY vec_id"),
    "img_matrix_save": px("SELECT vec_id, p, ((trunc(x * 255)::BIGINT % 256) + 256) % 256 AS px FROM pix"),
    "cnn_model_predict": px(
        "SELECT vec_id, w.o AS p, round(sum(v * w) + any_value(b), 6) AS v FROM m JOIN hw w ON m.p = w.k JOIN hb USING (o) GROUP BY vec_id, w.o",
        f"{CONV2}, {WINDOW}, {grid('hw', 2, 100, 7, 3, 19, 9)}, {bias('hb', 2, 3, 7)}, m AS (SELECT vec_id, (b * 25 + (y - i) * 5 + x - j)::BIGINT AS p, max(v)::DOUBLE AS v FROM c2, q WHERE y - i BETWEEN 0 AND 4 AND x - j BETWEEN 0 AND 4 GROUP BY ALL)",
    ),
}

# rounding leaves a sign on zero here, and none in Spark
for _name, _sql in SQL.items():
    for _column in ("v", "w"):
        if f" AS {_column} FROM" in _sql.rsplit("SELECT", 1)[-1]:
            SQL[_name] = f"SELECT * REPLACE ({_column} + 0 AS {_column}) FROM ({_sql})"
