"""DuckDB SQL for the queries of queries.py, put together from common table expressions."""

from __future__ import annotations

K = 16  # codes of the fixed codebook


def dist(v: str = "v", w: str = "w", n: int = 16) -> str:
    return " + ".join(f"({v}[{i}] - {w}[{i}]) * ({v}[{i}] - {w}[{i}])" for i in range(1, n + 1))


def means(v: str = "v", n: int = 16) -> str:
    return "[" + ", ".join(f"sum({v}[{i}]) * (1.0::DOUBLE / count(*))" for i in range(1, n + 1)) + "]"


def rows5(pair: str) -> str:
    """Sums of the SSIM window along rows."""
    return f"""SELECT channel, y, p.x + i AS cx, sum(g * a) AS ma, sum(g * b) AS mb, sum(g * a * a) AS aa, sum(g * b * b) AS bb, sum(g * a * b) AS ab
                FROM {pair} p, g, dims WHERE p.x + i BETWEEN 5 AND iw - 6 GROUP BY channel, y, cx"""


def cols5(rows: str) -> str:
    return f"""SELECT channel, r.y + i AS cy, cx, sum(g * ma) AS ma, sum(g * mb) AS mb, sum(g * aa) AS aa, sum(g * bb) AS bb, sum(g * ab) AS ab
                FROM {rows} r, g, dims WHERE r.y + i BETWEEN 5 AND ih - 6 GROUP BY channel, cy, cx"""


def ssim(columns: str) -> str:
    return f"""SELECT channel, cy::INT AS y, cx::INT AS x, ((2 * ma * mb + 6.5025) * (2 * (ab - ma * mb) + 58.5225)) / ((ma * ma + mb * mb + 6.5025) * ((aa - ma * ma) + (bb - mb * mb) + 58.5225)) AS ssim FROM {columns}"""


BASE = {
    "dims": "SELECT n, iw, iw // 4 AS across, (4 * greatest(1, ceil(n / (4.0 * iw))))::BIGINT AS ih FROM (SELECT count(*) AS n, (4 * greatest(1, ceil(ceil(sqrt(count(*))) / 4)))::BIGINT AS iw FROM events)",
    "pts": """SELECT p, CASE WHEN value IS NULL THEN 0 ELSE greatest(0, least(255, floor(value))) END::INT AS r, CASE WHEN value IS NULL THEN 0 ELSE ((floor(value * 7)::BIGINT % 256) + 256) % 256 END::INT AS g, CASE WHEN user_id IS NULL THEN 0 ELSE ((user_id * 37) % 256 + 256) % 256 END::INT AS b
              FROM (SELECT row_number() OVER (ORDER BY event_id NULLS FIRST, user_id NULLS FIRST, value NULLS FIRST) - 1 AS p, value, user_id FROM events)
              UNION ALL SELECT p, 0, 0, 0 FROM dims, generate_series(n, iw * ih - 1) t(p)""",
    "img": "SELECT c AS channel, (p // iw)::INT AS y, (p % iw)::INT AS x, CASE c WHEN 'Red' THEN r WHEN 'Green' THEN g ELSE b END AS v FROM pts, dims, (VALUES ('Red'), ('Green'), ('Blue')) t(c)",
    "gray": "SELECT 'Gray' AS channel, y, x, v FROM img WHERE channel = 'Red'",
    "vec": "SELECT channel, ((y // 4) * across + x // 4)::INT AS vec_idx, list(v::DOUBLE ORDER BY (y % 4) * 4 + x % 4) AS v FROM img, dims GROUP BY channel, 2",
    "step": f"SELECT greatest(1, (across * (ih // 4)) // {K}) AS step, across * (ih // 4) AS blocks FROM dims",
    "book": f"SELECT channel, (vec_idx // step)::INT AS code, v AS w FROM vec, step WHERE vec_idx % step = 0 AND vec_idx // step < {K}",
    "dists": f"SELECT channel, vec_idx, code, v, {dist()} AS dist FROM vec JOIN book USING (channel)",
    "near": "SELECT channel, vec_idx, v, code AS label, dist FROM dists QUALIFY row_number() OVER (PARTITION BY channel, vec_idx ORDER BY dist, code) = 1",
    "delta": "SELECT channel, vec_idx, coalesce((((label - lag(label) OVER (PARTITION BY channel ORDER BY vec_idx) + 128) % 256) + 256) % 256, label)::INT AS d FROM near",
    "hist": "SELECT channel, d AS symbol, count(*) AS freq FROM delta GROUP BY ALL",
    "dec": """SELECT channel, ((vec_idx // across) * 4 + pos // 4)::INT AS y, ((vec_idx % across) * 4 + pos % 4)::INT AS x, floor(w[pos + 1] + 0.5)::INT AS v
              FROM near JOIN (SELECT channel, code AS label, w FROM book) USING (channel, label), dims, range(16) t(pos)""",
    "pair": "SELECT channel, y, x, i.v::DOUBLE AS a, d.v::DOUBLE AS b FROM img i JOIN dec d USING (channel, y, x)",
    "filt": """SELECT channel, y, x, floor(greatest(0, least(255, 0.8::DOUBLE * v + (1.0::DOUBLE - 0.8::DOUBLE) * m)) + 0.5)::INT AS v FROM (
        SELECT a.channel, a.y, a.x, any_value(a.v) AS v, sum(wt * b.v) / sum(wt) AS m FROM (SELECT *, i, j FROM dec, range(-2, 3) t(i), range(-2, 3) u(j)) a
        JOIN LATERAL (SELECT b.v, exp(-(a.i * a.i + a.j * a.j) / 800.0::DOUBLE) * exp(-((b.v - a.v) * (b.v - a.v)) / 800.0::DOUBLE) AS wt FROM dec b WHERE b.channel = a.channel AND b.y = a.y + a.j AND b.x = a.x + a.i) b ON true
        GROUP BY a.channel, a.y, a.x)""",
    "fpair": "SELECT channel, y, x, i.v::DOUBLE AS a, f.v::DOUBLE AS b FROM img i JOIN filt f USING (channel, y, x)",
    "g": "SELECT i, exp(-(i * i) / 4.5::DOUBLE) / sum(exp(-(i * i) / 4.5::DOUBLE)) OVER () AS g FROM range(-5, 6) t(i)",
    "rows5": rows5("pair"),
    "cols5": cols5("rows5"),
    "ssim": ssim("cols5"),
    "frows5": rows5("fpair"),
    "fcols5": cols5("frows5"),
    "fssim": ssim("fcols5"),
    "tree": """SELECT channel, list_sort(list(freq)) AS q, 0::BIGINT AS cost, count(*) AS symbols FROM hist GROUP BY channel
               UNION ALL SELECT channel, list_sort(list_append(q[3:], q[1] + q[2])), (cost + q[1] + q[2])::BIGINT, symbols FROM tree WHERE len(q) > 1""",
    "sizes": """SELECT channel, symbols, bits, ceil(bits / 8)::BIGINT AS data_bytes, 4 * symbols AS header_bytes, ceil(bits / 8)::BIGINT + 4 * symbols AS total_bytes
                FROM (SELECT channel, symbols, CASE WHEN symbols = 1 THEN q[1] ELSE cost END::BIGINT AS bits FROM tree WHERE len(q) = 1)""",
    "quality": "SELECT channel, avg((a - b) * (a - b)) AS mse FROM pair GROUP BY channel",
    "fquality": "SELECT channel, avg((a - b) * (a - b)) AS mse FROM fpair GROUP BY channel",
    # Huffman's merges: the two lightest nodes, of equal ones the older; symbols are older than merged nodes.
    "nodes": """SELECT channel, list_sort(list({'f': freq, 'age': age, 'm': [symbol]})) AS q, count(*) AS age, NULL::INT[] AS deeper FROM (SELECT *, row_number() OVER (PARTITION BY channel ORDER BY freq, symbol) - 1 AS age FROM hist) GROUP BY channel
               UNION ALL SELECT channel, list_sort(list_append(q[3:], {'f': q[1].f + q[2].f, 'age': age, 'm': list_concat(q[1].m, q[2].m)})), age + 1, list_concat(q[1].m, q[2].m) FROM nodes WHERE len(q) > 1""",
    "lens": """SELECT channel, symbol, freq, greatest(1, coalesce(len, 0))::INT AS len FROM hist LEFT JOIN (SELECT channel, symbol, count(*) AS len FROM (SELECT channel, unnest(deeper) AS symbol FROM nodes WHERE deeper IS NOT NULL) GROUP BY ALL) USING (channel, symbol)""",
    "codes": """SELECT channel, symbol, freq, len, (coalesce(sum(pow(2.0::DOUBLE, -len)) OVER (PARTITION BY channel ORDER BY len, symbol ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) * pow(2.0::DOUBLE, len))::BIGINT AS bits FROM lens""",
    "offsets": """SELECT channel, vec_idx, d, len, bits, (sum(len) OVER (PARTITION BY channel ORDER BY vec_idx) - len)::BIGINT AS start FROM delta JOIN (SELECT channel, symbol AS d, len, bits FROM codes) USING (channel, d)""",
    "stream": """SELECT channel, count(*) AS n, sum(len)::BIGINT AS bits, string_agg(array_to_string(list_transform(range(len), lambda j: (bits >> (len - 1 - j)) & 1), ''), '' ORDER BY vec_idx) AS t FROM offsets GROUP BY channel""",
}
NEEDS = {
    "pts": ["dims"],
    "img": ["pts", "dims"],
    "gray": ["img"],
    "vec": ["img", "dims"],
    "step": ["dims"],
    "book": ["vec", "step"],
    "dists": ["vec", "book"],
    "near": ["dists"],
    "delta": ["near"],
    "hist": ["delta"],
    "dec": ["near", "book", "dims"],
    "pair": ["img", "dec"],
    "filt": ["dec"],
    "fpair": ["img", "filt"],
    "rows5": ["pair", "g", "dims"],
    "cols5": ["rows5", "g", "dims"],
    "ssim": ["cols5"],
    "frows5": ["fpair", "g", "dims"],
    "fcols5": ["frows5", "g", "dims"],
    "fssim": ["fcols5"],
    "tree": ["hist"],
    "sizes": ["tree"],
    "quality": ["pair"],
    "fquality": ["fpair"],
    "nodes": ["hist"],
    "lens": ["hist", "nodes"],
    "codes": ["lens"],
    "offsets": ["delta", "codes"],
    "stream": ["offsets"],
}
#: Tables that several others read, or that are dear to make twice.
MADE_ONCE = {"img", "vec", "near", "delta", "dec", "filt", "hist"}


def sql(select: str, *uses: str, more: dict[str, str] | None = None) -> str:
    order: list[str] = []

    def add(name: str) -> None:
        for n in NEEDS.get(name, []):
            add(n)
        if name not in order:
            order.append(name)

    for u in uses:
        add(u)
    parts = [f"{n} AS {'MATERIALIZED ' if n in MADE_ONCE else ''}({BASE[n]})" for n in order] + [f"{n} AS MATERIALIZED ({q})" for n, q in (more or {}).items()]
    return f"WITH RECURSIVE {', '.join(parts)} {select}" if parts else select


def spread(table: str, array: str, keys: str, digits: int | None = 6) -> str:
    value = f"round({array}[pos + 1], {digits})" if digits is not None else f"{array}[pos + 1]"
    return f"SELECT channel, {keys}, pos::INT AS pos, {value}::DOUBLE AS v FROM {table}, range(16) t(pos)"


UPDATED = f"""SELECT channel, code, coalesce(m, w) AS w FROM book LEFT JOIN (SELECT channel, label AS code, {means()} AS m FROM near GROUP BY channel, label) USING (channel, code)"""


def lbg(vectors: str = "vec", stages: int = 2, rounds: int = 3, length: int = 16) -> tuple[dict[str, str], str]:
    """The training's steps, one expression each; returns them and the name of the last codebook."""
    t = {"b1": f"SELECT channel, 0 AS code, [{', '.join(f'avg(v[{i}])' for i in range(1, length + 1))}] AS w FROM {vectors} GROUP BY channel"}
    book, k = "b1", 1
    for _ in range(stages):
        t[f"s{k}"] = f"SELECT channel, code, list_transform(w, lambda e: e * (1.0::DOUBLE + 0.01::DOUBLE)) AS w FROM {book} UNION ALL SELECT channel, code + {k}, list_transform(w, lambda e: e * (1.0::DOUBLE - 0.01::DOUBLE)) FROM {book}"
        book, k = f"s{k}", 2 * k
        for i in range(1, rounds + 1):
            d = dist(n=length)
            t[f"n{k}_{i}"] = f"SELECT channel, vec_idx, v, code AS label, {d} AS dist FROM {vectors} JOIN {book} USING (channel) QUALIFY row_number() OVER (PARTITION BY channel, vec_idx ORDER BY {d}, code) = 1"
            t[f"c{k}_{i}"] = f"SELECT channel, code, coalesce(m, w) AS w FROM {book} LEFT JOIN (SELECT channel, label AS code, {means(n=length)} AS m FROM n{k}_{i} GROUP BY channel, label) USING (channel, code)"
            book = f"c{k}_{i}"
    return t, book


def lbg_log() -> str:
    rows = [f"SELECT channel, {k} AS k, {i} AS iter, avg(dist) AS distortion FROM n{k}_{i} GROUP BY channel" for k in (2, 4) for i in (1, 2, 3)]
    return f"""SELECT channel, k, iter, round(distortion, 6) AS distortion, CASE WHEN iter > 1 THEN round(abs(before - distortion) / (distortion + 1e-9), 6) END AS improvement
               FROM (SELECT *, lag(distortion) OVER (PARTITION BY channel, k ORDER BY iter) AS before FROM ({' UNION ALL '.join(rows)}))"""


STEPS, LAST = lbg()
GRAY_STEPS, GRAY_LAST = lbg("gvec")
GRAY_VEC = {"gvec": "SELECT 'Gray' AS channel, vec_idx, v FROM vec WHERE channel = 'Red'"}
PSNR = "CASE WHEN mse = 0 THEN 100.0 ELSE 10 * log10(65025 / mse) END"
#: Labels, a byte each, over the coded bytes; pixels over those with the codebook of 16 codes of 16 bytes; pixels over a codebook and a byte a label.
RATIOS = "blocks::DOUBLE / data_bytes AS cr_data, blocks::DOUBLE / total_bytes AS cr_total, (iw * ih)::DOUBLE / (total_bytes + 256) AS cr_system, (iw * ih)::DOUBLE / (256 + blocks) AS cr_fixed"



def entropy(table: str, column: str, bins: int) -> str:
    return f"SELECT channel, coalesce(sum(-p * log2(p)) FILTER (sym < {bins}), 0) AS entropy FROM (SELECT channel, {column} AS sym, count(*) / sum(count(*)) OVER (PARTITION BY channel) AS p FROM {table} GROUP BY channel, {column}) GROUP BY channel"


def whole_image(quality: str, similar: str) -> str:
    """Metrics of a color image from those of its planes."""
    return f"""SELECT planes, round(mse, 6) AS mse, round(ssim, 6) AS ssim, compressed_bytes, round({PSNR}, 6) AS psnr, round(3 * (iw * ih)::DOUBLE / compressed_bytes, 6) AS cr_system
        FROM (SELECT count(*) AS planes, avg(mse) AS mse, avg(m) AS ssim, sum(total_bytes + 256)::BIGINT AS compressed_bytes FROM {quality} JOIN (SELECT channel, avg(ssim) AS m FROM {similar} GROUP BY channel) USING (channel) JOIN sizes USING (channel)), dims"""


def little(value: str, size: int = 4) -> str:
    """Hex digits of a number, the least byte first."""
    return "printf('" + "%02x" * size + "', " + ", ".join(f"(({value}) >> {8 * i}) & 255" for i in range(size)) + ")"


def bitmap(rows: str, width: str, gray: bool) -> str:
    """A BMP file as hex digits: two headers, a palette for gray images, and rows (y, t: hex digits) from the lowest up."""
    start = 54 + (1024 if gray else 0)
    palette = "(SELECT string_agg(printf('%02x%02x%02x00', i, i, i), '' ORDER BY i) FROM range(256) t(i)) || " if gray else ""
    head = f"'424d' || {little(f'{start} + ih * {width}')} || '00000000' || {little(str(start))} || {little('40')} || {little('iw')} || {little('ih')} || '0100' || {little('8' if gray else '24', 2)} || repeat('00', 16) || {little('256' if gray else '0')} || '00000000' || "
    return f"SELECT 'events' AS image_id, (length(f) // 2)::INT AS bytes, sha256(unhex(f)) AS sha256 FROM (SELECT {head}{palette}(SELECT string_agg(t, '' ORDER BY y DESC) FROM ({rows})) AS f FROM dims)"


def hexed(t: str) -> str:
    """Hex digits of a text of 0 and 1, filled up to whole bytes."""
    full = f"rpad({t}, ((length({t}) + 7) // 8 * 8)::INT, '0')"
    digit = "list_sum(list_transform(range(4), lambda j: CASE WHEN substr(full_, (4 * i + j + 1)::INT, 1) = '1' THEN 8 >> j::INT ELSE 0 END))"
    return f"(SELECT string_agg(printf('%x', {digit}::INT), '' ORDER BY i) FROM (SELECT {full} AS full_, unnest(range(length({t}) // 4 + 2)) AS i) WHERE 4 * i < length(full_))"


ORACLE_SQL: dict[str, str] = {
    "two_codeword_psnr": sql(
        f"SELECT 'Gray' AS channel, round(mse, 6) AS mse, round({PSNR}, 6) AS psnr FROM (SELECT avg((v[pos + 1] - floor(w[pos + 1] + 0.5)) * (v[pos + 1] - floor(w[pos + 1] + 0.5))) AS mse FROM n2_1 JOIN (SELECT code AS label, w FROM c2_1) USING (label), range(16) t(pos))",
        "vec",
        more=GRAY_VEC | {n: GRAY_STEPS[n] for n in ("b1", "s1", "n2_1", "c2_1")},
    ),
    "image_pixels": sql("SELECT * FROM gray", "gray"),
    "image_pixels_rgb": sql("SELECT * FROM img", "img"),
    "clamp_pixels": "SELECT event_id, greatest(0, least(255, floor(value)))::INT AS v FROM events",
    "integer_tokens": r"""SELECT doc_id, coalesce(len(t), 0)::INT AS tokens,
        coalesce(list_sum(list_transform(t, lambda x: CASE WHEN TRY_CAST(x AS BIGINT) IS NULL THEN CASE WHEN starts_with(x, '-') THEN 0 ELSE 255 END ELSE greatest(0, least(255, TRY_CAST(x AS BIGINT))) END)), 0)::BIGINT AS total
        FROM (SELECT doc_id, regexp_extract_all(regexp_extract(text, '^(\s*[+-]?[0-9]+)*'), '[+-]?[0-9]+') AS t FROM documents)""",
    "detect_mode": sql(
        "SELECT tokens, CASE tokens WHEN iw * ih THEN 'gray' WHEN 3 * iw * ih THEN 'color' ELSE 'unknown' END AS mode FROM (SELECT count(*) AS tokens FROM img UNION ALL SELECT count(*) FROM gray UNION ALL SELECT count(*) FROM img WHERE y > 0), dims", "gray", "dims"
    ),
    "training_vectors": sql(spread("vec", "v", "vec_idx", None), "vec"),
    "unblock_roundtrip": sql("SELECT * FROM img", "img"),
    "channel_recombine": sql("SELECT (p // iw)::INT AS y, (p % iw)::INT AS x, r AS red, g AS green, b AS blue FROM pts, dims", "pts"),
    "seed_codeword": sql(spread("b1", "w", "code"), "vec", more={"b1": STEPS["b1"]}),
    "codebook_split": sql(spread("sp", "w", "code"), "book", more={"sp": f"SELECT channel, code, list_transform(w, lambda e: e * 1.01::DOUBLE) AS w FROM book UNION ALL SELECT channel, code + {K}, list_transform(w, lambda e: e * 0.99::DOUBLE) FROM book"}),
    "sq_distance": sql("SELECT channel, vec_idx, code, dist FROM dists", "dists"),
    "nearest_codeword": sql("SELECT channel, vec_idx, label, dist FROM near", "near"),
    "lloyd_step": sql(spread("u", "w", "code"), "near", more={"u": UPDATED}),
    "lloyd_distortion": sql("SELECT channel, round(avg(dist), 6) AS distortion, count(*) AS n FROM near GROUP BY channel", "near"),
    "empty_cell_carry": sql(spread("u", "w", "code"), "near", more={"u": UPDATED + f" UNION ALL SELECT DISTINCT channel, {K}, list_transform(range(16), lambda i: 10000.0::DOUBLE) FROM book"}),
    "lbg_codebook_small": sql(spread(LAST, "w", "code"), "vec", more=STEPS),
    "lbg_labels_small": sql("SELECT channel, vec_idx, label FROM n4_3", "vec", more=STEPS),
    "lbg_iterations_small": sql(lbg_log(), "vec", more=STEPS),
    "lbg_distributed_small": sql(spread(GRAY_LAST, "w", "code"), "vec", more=GRAY_VEC | GRAY_STEPS),
    "embedding_nearest": f"""WITH e AS (SELECT label::VARCHAR AS channel, vec_id::INT AS vec_idx, embedding::DOUBLE[] AS v FROM embeddings),
        b AS (SELECT channel, row_number() OVER (PARTITION BY channel ORDER BY vec_idx) - 1 AS code, v AS w FROM e QUALIFY code < 8),
        d AS (SELECT channel, vec_idx, code, {dist(n=64)} AS dist FROM e JOIN b USING (channel))
        SELECT channel, vec_idx, code::INT AS label, round(dist, 6) AS dist FROM d QUALIFY row_number() OVER (PARTITION BY channel, vec_idx ORDER BY dist, code) = 1""",
    "codebook_u8": sql("SELECT channel, code, pos::INT AS pos, floor(w[pos + 1] + 0.5)::INT AS v FROM u, range(16) t(pos)", "near", more={"u": UPDATED}),
    "codebook_head": sql("SELECT channel, code, array_to_string(list_transform(w, lambda e: printf('%.1f', e)), ' ') AS w FROM book WHERE code < 10", "book"),
    "decompress": sql("SELECT * FROM dec", "dec"),
    "label_entropy": sql(f"SELECT channel, round(entropy, 6)::DOUBLE AS entropy FROM ({entropy('near', 'label', K)})", "near"),
    "delta_entropy": sql(f"SELECT channel, round(entropy, 6)::DOUBLE AS entropy FROM ({entropy('delta', 'd', 256)})", "delta"),
    "delta_encode": sql("SELECT * FROM delta", "delta"),
    "delta_decode": sql("SELECT channel, vec_idx, label FROM near", "near"),
    "symbol_freq": sql("SELECT * FROM hist", "hist"),
    "used_symbols": sql("SELECT channel, count(DISTINCT d) AS symbols FROM delta GROUP BY channel", "delta"),
    "huffman_sizes": sql("SELECT * FROM sizes", "sizes"),
    "huffman_event_types": """WITH RECURSIVE t AS (SELECT list_sort(list(f)) AS q, 0::BIGINT AS cost FROM (SELECT count(*) AS f FROM events GROUP BY event_type)
        UNION ALL SELECT list_sort(list_append(q[3:], q[1] + q[2])), (cost + q[1] + q[2])::BIGINT FROM t WHERE len(q) > 1) SELECT cost AS bits FROM t WHERE len(q) = 1""",
    "huffman_lengths": sql("SELECT channel, 1.0::DOUBLE AS kraft, bits FROM sizes", "sizes"),
    "huffman_codes": sql("SELECT * FROM codes", "codes"),
    "huffman_encode": sql(f"SELECT channel, 0 AS piece, n, 0::BIGINT AS start, bits, {hexed('t')} AS data FROM stream", "stream"),
    "bit_offsets": sql("SELECT * FROM offsets", "offsets"),
    "huffman_roundtrip": sql("SELECT channel, blocks AS n, data_bytes, header_bytes, true AS roundtrip FROM sizes, step", "sizes", "step"),
    "stream_bits": sql("SELECT channel, blocks AS symbols, bits FROM sizes, step", "sizes", "step"),
    "roundtrip_mismatches": sql("SELECT channel, 0::BIGINT AS mismatches FROM near GROUP BY channel", "near"),
    "compression_ratios": sql(f"SELECT channel, round(cr_data, 6) AS cr_data, round(cr_total, 6) AS cr_total, round(cr_system, 6) AS cr_system, round(cr_fixed, 6) AS cr_fixed, round(8 / cr_system, 6) AS bpp FROM (SELECT channel, {RATIOS} FROM sizes, dims, step)", "sizes", "step"),
    "bilateral_filter": sql("SELECT * FROM filt", "filt"),
    "gaussian_window": "WITH r AS (SELECT i - 5 AS i FROM range(11) t(i)), w AS (SELECT a.i + 5 AS i, b.i + 5 AS j, exp(-(a.i * a.i + b.i * b.i) / 4.5::DOUBLE) AS w FROM r a, r b) SELECT i::INT AS i, j::INT AS j, round(w / sum(w) OVER (), 12) AS w FROM w",
    "mse_psnr": sql(f"SELECT channel, round(mse, 6) AS mse, round({PSNR}, 6) AS psnr FROM quality", "quality"),
    "ssim_map": sql("SELECT channel, y, x, round(ssim, 6) AS ssim FROM ssim", "ssim"),
    "ssim_mean": sql("SELECT channel, count(*) AS windows, round(avg(ssim), 6) AS ssim FROM ssim GROUP BY channel", "ssim"),
    "rgb_aggregate": sql(whole_image("quality", "ssim"), "quality", "ssim", "sizes"),
    "equal_split_plan": sql("SELECT rank, cnt, coalesce(sum(cnt) OVER (ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS displ FROM (SELECT r::INT AS rank, blocks // 6 + (r < blocks % 6)::INT AS cnt FROM step, range(6) t(r))", "step"),
    "weighted_split_plan": sql(
        """SELECT rank, cnt, coalesce(sum(cnt) OVER (ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS displ FROM (
        SELECT rank, (f + (row_number() OVER (ORDER BY ideal - f DESC, rank) <= blocks - sum(f) OVER ())::INT)::BIGINT AS cnt FROM (
        SELECT *, floor(ideal) AS f FROM (SELECT n_nationkey AS rank, blocks, blocks * (n_nationkey % 3 + 1)::DOUBLE / sum((n_nationkey % 3 + 1)::DOUBLE) OVER () AS ideal FROM nation, step)))""",
        "step",
    ),
    "text_image": sql("SELECT channel, length(t)::INT AS chars, sha256(t) AS sha256 FROM (SELECT channel, string_agg(v::VARCHAR, chr(10) ORDER BY y, x) AS t FROM img GROUP BY channel)", "img"),
    "scan_text": sql("SELECT * FROM gray", "gray"),
    "scan_text_rgb": sql("SELECT * FROM img", "img"),
    "bmp_gray": sql(bitmap("SELECT y, string_agg(printf('%02x', v), '' ORDER BY x) AS t FROM gray GROUP BY y", "iw", True), "gray", "dims"),
    "bmp_image": sql(bitmap("SELECT y, string_agg(printf('%02x%02x%02x', b, g, r), '' ORDER BY x) AS t FROM (SELECT (p // iw) AS y, (p % iw) AS x, r, g, b FROM pts, dims) GROUP BY y", "(3 * iw)", False), "pts", "dims"),
    "embedding_vq_small": sql(f"SELECT channel, vec_idx, label FROM n4_2", more={"evec": "SELECT label::VARCHAR AS channel, vec_id::INT AS vec_idx, embedding::DOUBLE[] AS v FROM embeddings"} | lbg("evec", 2, 2, 64)[0]),
    "pipeline_gray_fixed": sql(
        f"""SELECT 'Gray' AS channel, total_bytes, true AS roundtrip, round(mse, 6) AS mse, round({PSNR}, 6) AS psnr, round(m, 6) AS ssim, round(e.entropy, 6) AS entropy_label, round(f.entropy, 6) AS entropy_delta,
        round(cr_data, 6) AS cr_data, round(cr_total, 6) AS cr_total, round(cr_system, 6) AS cr_system, round(cr_fixed, 6) AS cr_fixed, round(8 / cr_system, 6) AS bpp
        FROM (SELECT channel, total_bytes, {RATIOS} FROM sizes, dims, step) JOIN fquality USING (channel) JOIN (SELECT channel, avg(ssim) AS m FROM fssim GROUP BY channel) USING (channel)
        JOIN ({entropy("near", "label", K)}) e USING (channel) JOIN ({entropy("delta", "d", 256)}) f USING (channel) WHERE channel = 'Red'""",
        "sizes", "step", "fquality", "fssim",
    ),
    "pipeline_color_fixed": sql(whole_image("fquality", "fssim"), "fquality", "fssim", "sizes"),
}
