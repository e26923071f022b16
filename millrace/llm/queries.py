"""The operators as driver queries: each applies its operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from millrace.llm import fingerprint, html_extract, lattice, mixing, near_dup, packing, quality, sort_means, spelling, stream_packing, substring_dedup, token_files, toxicity
from millrace.llm.common import documents


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    """A public vocabulary file of the queries; the operators take any path."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def op1_lattice_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op2_quality_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_documents(documents(spark, sf_dir), _labels(spark, sf_dir))


def op3_iblt_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.edit_likeness(documents(spark, sf_dir))


def op4_toxicity_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return toxicity.score(docs, toxicity.fit(docs, _labels(spark, sf_dir)))


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op6_paragraph_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = substring_dedup.merged(substring_dedup.find_repeats(documents(spark, sf_dir)))
    return spans.select("doc_id", "start", "end", "cluster", "first_doc_id", "n_paragraphs")


def op7_minhash_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(documents(spark, sf_dir))


#: Units of weight by source: fixed target weights for the sources of the test tables, 100 in all.
TARGETS = dict(zip([f"src{i}" for i in range(20)], [10, 8, 8, 6, 6, 6, 5, 5, 5, 5, 4, 4, 4, 4, 4, 4, 3, 3, 3, 3], strict=True))


def op8_pfair_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir).select("doc_id", "source"), TARGETS)


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir), vocabulary())


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.read_token_files(token_files.write_token_files(documents(spark, sf_dir), vocabulary()))


def op11_sort_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sort_means.cluster_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op12_concatenate_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stream_packing.concatenate(documents(spark, sf_dir), vocabulary("word_bpe_49k.json"), keep_ids=False).drop("ids")


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_lattice_near_dup": op1_lattice_near_dup,
    "op2_quality_gam": op2_quality_gam,
    "op3_iblt_fingerprint": op3_iblt_fingerprint,
    "op4_toxicity_fm": op4_toxicity_fm,
    "op5_html_extraction": op5_html_extraction,
    "op6_paragraph_dedup": op6_paragraph_dedup,
    "op7_minhash_near_dup": op7_minhash_near_dup,
    "op8_pfair_mixing": op8_pfair_mixing,
    "op9_best_fit_packing": op9_best_fit_packing,
    "op10_token_files": op10_token_files,
    "op11_sort_means": op11_sort_means,
    "op12_concatenate_cut": op12_concatenate_cut,
    "op13_spelling_variants": op13_spelling_variants,
}


# SQL, written apart from the operators and with constants of its own


def _mixing_sql() -> str:
    """The schedule by recursion over the slots of one period, and each row's slot from its rank in its source."""
    units = [10, 8, 8, 6, 6, 6, 5, 5, 5, 5, 4, 4, 4, 4, 4, 4, 3, 3, 3, 3, 1]  # src0 to src19, and the rest
    d, n, block = sum(units), len(units), 16
    u = f"[{', '.join(map(str, units))}]"
    due = f"cast(ceil((nxt[i + 1] + 1) * {d} / {u}[i + 1]) AS BIGINT) * 1000 + i"
    best = f"list_min(list_transform(range({n}), lambda i: CASE WHEN nxt[i + 1] * {d} // {u}[i + 1] <= t + 1 THEN {due} END)) % 1000"
    return f"""
WITH RECURSIVE target(source, class, u) AS (VALUES {', '.join(f"('src{i}', {i}, {x})" for i, x in enumerate(units[:-1]))}),
run(t, nxt, pick) AS (
  SELECT -1::BIGINT, list_transform(range({n}), lambda x: 0::BIGINT), -1::BIGINT
  UNION ALL
  SELECT t + 1, list_transform(nxt, lambda x, i: CASE WHEN i - 1 = p THEN x + 1 ELSE x END), p
  FROM (SELECT t, nxt, {best} AS p FROM run WHERE t + 1 < {d})
),
turn AS (SELECT t AS slot, pick AS class, row_number() OVER (PARTITION BY pick ORDER BY t) - 1 AS turn FROM run WHERE t >= 0),
ranked AS (
  SELECT doc_id, d.source, coalesce(class, {n - 1}) AS class, coalesce(u, 1) AS u,
         row_number() OVER (PARTITION BY coalesce(class, {n - 1}) ORDER BY md5(coalesce(doc_id::VARCHAR, '')), doc_id) - 1 AS r
  FROM documents d LEFT JOIN target ON d.source = target.source
)
SELECT doc_id, source, ranked.class::INTEGER AS mix_class, (r // {block})::BIGINT AS mix_block,
       ((r // {block}) // u * {d} + slot)::BIGINT AS mix_slot, (r % {block})::INTEGER AS mix_place
FROM ranked JOIN turn ON ranked.class = turn.class AND (r // {block}) % u = turn.turn
"""


#: Who reaches whom over links (a, b) from the nodes of a table (id): each node with the least one reachable.
_REACHED = """both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(node, far) AS (SELECT id, id FROM nodes UNION SELECT r.node, b.b FROM reach r JOIN both_ways b ON r.far = b.a),
least_of AS (SELECT node, min(far) AS component_id FROM reach GROUP BY node)"""

_VECTORS_SQL = f"""
WITH RECURSIVE v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0
  AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x))) AND list_bool_or(list_transform(embedding, lambda x: x <> 0))),
links AS (SELECT l.vec_id AS a, r.vec_id AS b FROM v l JOIN v r ON l.label = r.label AND l.vec_id < r.vec_id AND len(l.e) = len(r.e) WHERE list_cosine_similarity(l.e, r.e) >= 0.98),
nodes AS (SELECT vec_id AS id FROM embeddings), {_REACHED},
linked AS (SELECT a, count(*) AS n FROM both_ways GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept FROM embeddings JOIN least_of ON vec_id = node LEFT JOIN linked ON vec_id = a
"""

_SHINGLED = "string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \\t\\n\\x0B\\f\\r]+')"
_NEAR_SQL = f"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter({_SHINGLED}, lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) > 1 THEN list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) ELSE w END) AS s FROM w),
e AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM s),
links AS (SELECT a, b FROM (SELECT l.doc_id AS a, r.doc_id AS b, any_value(l.n) AS n, any_value(r.n) AS m, count(*) AS i FROM e l JOIN e r ON l.x = r.x AND l.doc_id < r.doc_id GROUP BY 1, 2) WHERE 100 * i >= 80 * (n + m - i)),
nodes AS (SELECT doc_id AS id FROM s), {_REACHED}
SELECT doc_id, len(s)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM s JOIN least_of ON doc_id = node
"""


def _fingerprint_sql() -> str:
    """Codes of paragraphs as sets; the cells of a sketch are counted and combined from the whole set, and likeness is that of sets."""
    check = "((d % 1048573) * (d // 1048573 + 12345) % 1048573)"
    parts = lambda t: f"list_filter(string_split_regex(regexp_replace({t}, '([.!?])[ \\t\\n\\x0B\\f\\r]+', '\\1' || chr(10), 'g'), '\\n+'), lambda p: p <> '')"
    codes = lambda t: f"list_distinct(list_transform(list_transform({parts(t)}, lambda p: ('0x' || md5(p)[1:11])::UBIGINT), lambda d: d * 1048576 + {check}))"
    cell = lambda c: f"CASE WHEN len({c}) = 0 THEN '' ELSE len({c}) || '.' || to_hex(list_reduce({c}, lambda x, y: xor(x, y))) END"
    row = lambda s, bit: f"list_transform(range(8), lambda i: {cell(f'list_filter({s}, lambda k: (k // {1 << bit}::UBIGINT) % 8 = i)')})"
    shown = lambda t, s: f"'ibl2-' || md5({t})[1:16] || '-' || len({s}) || '-' || array_to_string(list_concat(list_concat({row(s, 34)}, {row(s, 37)}), {row(s, 40)}), ',')"
    alike = lambda x, y: f"CASE WHEN len({x}) + len({y}) = 0 THEN 1 ELSE 1 - (len({x}) + len({y}) - 2 * len(list_intersect({x}, {y}))) / (len({x}) + len({y})) END::DOUBLE"
    return f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
n AS (SELECT doc_id, text, length(text) AS n_chars, coalesce(lead(text) OVER (ORDER BY doc_id), first_value(text) OVER (ORDER BY doc_id)) AS following FROM t),
e AS (SELECT *, text[1:n_chars - n_chars // 4] || CASE WHEN n_chars >= 4 THEN following[1:n_chars // 4] ELSE '' END AS edited FROM n),
c AS (SELECT *, {codes('text')} AS a, {codes('edited')} AS e, {codes('following')} AS b FROM e)
SELECT doc_id, n_chars::BIGINT AS n_chars, sha256(edited) AS edited_sha256, {shown('text', 'a')} AS fingerprint, {shown('edited', 'e')} AS edited_fingerprint, {alike('a', 'e')} AS near_edited, {alike('a', 'b')} AS near_next FROM c
"""


def _means_sql() -> str:
    """Each round's nearest centroids from all distances, and the floors of the means."""
    square = "list_sum(list_transform(list_zip(v.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
    nearest = lambda i: f"a{i} AS (SELECT row_id, vec_id, v.v AS v, min(({square}, c.c)) AS best FROM v, c{i} c GROUP BY row_id, vec_id, v.v)"
    means = lambda i: (
        f"s{i} AS (SELECT c, list(floor(s / n)::BIGINT ORDER BY p) AS v FROM (SELECT best[2] AS c, p, sum(v[p])::DOUBLE AS s, count(*) AS n FROM a{i}, range(1, 65) t(p) GROUP BY 1, 2) GROUP BY c), "
        f"c{i + 1} AS (SELECT c.c, coalesce(s{i}.v, c.v) AS v FROM c{i} c LEFT JOIN s{i} ON c.c = s{i}.c)"
    )
    rounds = ", ".join(f"{nearest(i)}, {means(i)}" for i in range(5))
    return f"""
WITH v AS (SELECT row_number() OVER () AS row_id, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = 64 AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))),
c0 AS (SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id), v) - 1 AS c, v FROM v WHERE vec_id IS NOT NULL QUALIFY c < 40),
{rounds}, {nearest(5)}
SELECT vec_id, best[2]::INTEGER AS cluster, best[1]::BIGINT AS distance, (sum(best[1]) OVER (PARTITION BY best[2]))::BIGINT AS cluster_inertia, (sum(best[1]) OVER ())::BIGINT AS inertia,
       sha256(array_to_string(c5.v, ',')) AS centroid_sha256
FROM a5 JOIN c5 ON best[2] = c5.c
"""


def _spelling_sql() -> str:
    """Runs with their CRC-32 byte by byte; near words by what is left of them without one letter."""
    step = "list_reduce([x::BIGINT, 0, 0, 0, 0, 0, 0, 0, 0], lambda h, z: CASE WHEN h % 2 = 1 THEN xor(h // 2, 3988292384) ELSE h // 2 END)"
    octets = "list_transform(range(1, 2 * octet_length(encode(key)), 2), lambda i: ('0x' || hex(encode(key))[i:i + 1])::BIGINT)"
    crc = f"xor(list_reduce(list_prepend(4294967295::BIGINT, {octets}), lambda h, x: xor(h // 256, steps[xor(h, x) % 256 + 1])), 4294967295)"
    without = "left(word, i - 1)"
    return f"""
WITH RECURSIVE table_of AS (SELECT list_transform(range(256), lambda x: {step}) AS steps),
runs AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\u00C0-\u00FF]+')) AS run FROM documents),
each AS (SELECT doc_id, run, count(*) AS n, coalesce(doc_id::VARCHAR, '') || ':' || run AS key FROM runs WHERE length(run) >= 7 GROUP BY doc_id, run),
hashed AS (SELECT run, n, {crc} AS h FROM each, table_of),
cut AS (SELECT CASE WHEN h % 31 = 0 THEN left(run, (h % length(run))::BIGINT) || substr(run, (h % length(run))::BIGINT + 2) ELSE run END AS word, n FROM hashed),
words AS (SELECT word, sum(n)::BIGINT AS n FROM cut WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
gaps AS (SELECT word, n, {without} || substr(word, i + 1) AS less, {without} || '*' || substr(word, i + 1) AS hole FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
one_way AS (SELECT g.word AS a, w.word AS b FROM gaps g JOIN words w ON g.less = w.word),
near AS (SELECT a, b FROM one_way UNION SELECT b, a FROM one_way UNION SELECT x.word, y.word FROM gaps x JOIN gaps y ON x.hole = y.hole AND x.word <> y.word),
best AS (SELECT a, count(*) AS n_near, arg_min(b, (-n, b)) AS form, max(n) AS form_n FROM near JOIN words ON b = word GROUP BY a),
formed AS (SELECT w.word, w.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN form_n >= 10 * w.n THEN form END AS form, CASE WHEN form_n >= 10 * w.n THEN form_n END AS form_n FROM words w LEFT JOIN best ON w.word = a),
path(word, reached, depth) AS (SELECT word, word, 0 FROM formed UNION ALL SELECT p.word, f.form, depth + 1 FROM path p JOIN formed f ON p.reached = f.word WHERE f.form IS NOT NULL),
ends AS (SELECT word, arg_max(reached, depth) AS root FROM path GROUP BY word)
SELECT word, form, root, n, n_near, form_n FROM formed JOIN ends USING (word)
"""


#: DuckDB SQL for those whose rows SQL can express.
ORACLE_SQL: dict[str, str] = {"op1_lattice_near_dup": _VECTORS_SQL, "op3_iblt_fingerprint": _fingerprint_sql(), "op7_minhash_near_dup": _NEAR_SQL, "op8_pfair_mixing": _mixing_sql(), "op11_sort_means": _means_sql(), "op13_spelling_variants": _spelling_sql()}
