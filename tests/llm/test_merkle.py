"""Merkle manifest against a tree built in one go."""

from hashlib import sha256
from zlib import crc32

from pyspark.sql import functions as F

from tracewell.llm import merkle


def h(*texts):
    return sha256("".join(texts).encode()).hexdigest()


def field(x):
    return "-" if x is None else f"{len(str(x).encode())}:{x}"


def tree(leaves):
    """The root, and the siblings of each leaf level by level as (before, after)."""
    proofs, level, at = [[] for _ in leaves], leaves, list(range(len(leaves)))
    while len(level) > 1:
        for k in range(len(leaves)):
            run = level[at[k] // 3 * 3 :][:3]
            proofs[k].append((run[: at[k] % 3], run[at[k] % 3 + 1 :]))
        level = [h(*level[i : i + 3]) for i in range(0, len(level), 3)]
        at = [a // 3 for a in at]
    return level[0], proofs


def expected(rows):
    """rows of (doc_id, source, lang, n_chars, text) -> rows of op12."""
    by_source = {}
    for r in rows:
        doc_id, *middle, text = r
        changed = text.replace("\n", "") if text is not None and doc_id is not None and crc32(str(doc_id).encode()) % 2 == 0 else text
        leaf, other = (h(*map(field, [doc_id, *middle, t])) for t in (text, changed))
        by_source.setdefault(r[1], []).append((doc_id is not None, doc_id or 0, leaf, other, doc_id))
    names = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in names:
        by_source[s].sort()
        trees[s] = tree([x[2] for x in by_source[s]])
    root, tops = tree([trees[s][0] for s in names])
    out = []
    for s, top in zip(names, tops, strict=True):
        for (_, _, leaf, other, doc_id), proof in zip(by_source[s], trees[s][1], strict=True):
            whole, found = proof + top, other
            for before, after in whole:
                found = h(*before, found, *after)
            out.append((doc_id, leaf, trees[s][0], root, h(*(x for b, a in whole for x in b + a)), found, found == root))
    return sorted(out, key=repr)


def found(docs, rows_per_part):
    fields = ["doc_id", "source", "lang", "n_chars"]
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.translate("text", "\n", "")).otherwise(F.col("text"))
    leaves = docs.select("doc_id", "source", merkle.digest(map(F.col, [*fields, "text"])).alias("leaf"), merkle.digest([*map(F.col, fields), tampered]).alias("tampered"))
    proved = merkle.folded(merkle.manifest(leaves, "leaf", "source", ["doc_id"], ["doc_id", "leaf", "tampered"], rows_per_part), "tampered", "proof", "back")
    rows = proved.select("doc_id", "leaf", "subroot", "root", F.sha2(merkle.siblings(F.col("proof")), 256), "back", F.col("back") == F.col("root"))
    return sorted((tuple(r) for r in rows.collect()), key=repr)


def test_odd_rows(odd):
    docs = odd.select("doc_id", "source", "lang", "n_chars", "text")
    want = expected([tuple(r) for r in docs.collect()])
    assert found(docs, 1 << 15) == want
    assert found(docs, 3) == want


def test_many_borders(spark):
    """Groups that span many partitions, that lie within one, and of one row; more groups than fit a partition."""
    docs = spark.range(1500).selectExpr("id AS doc_id", "CASE WHEN id % 3 = 0 THEN 'hot' WHEN id % 7 = 0 THEN NULL ELSE concat('s', id % 211) END AS source", "'en' AS lang", "id AS n_chars", "concat('line\n', id % 50) AS text").repartition(5)
    want = expected([tuple(r) for r in docs.collect()])
    assert found(docs, 11) == want
    assert found(docs, 200) == want


def test_deep_tree_and_equal_rows(spark):
    """One group with levels above one shuffle's rise, and rows that repeat."""
    docs = spark.range(2300).selectExpr("id % 2000 AS doc_id", "'a' AS source", "CAST(NULL AS STRING) AS lang", "CAST(NULL AS BIGINT) AS n_chars", "'x\ny' AS text")
    assert found(docs, 40) == expected([tuple(r) for r in docs.collect()])


def test_empty(empty):
    assert found(empty, 10) == []


def test_a_changed_leaf_fails(spark):
    rows = spark.createDataFrame([(k, "a", h(str(k))) for k in range(10)], "id long, g string, leaf string")
    proved = merkle.manifest(rows, "leaf", "g", ["id"], ["id", "leaf"])
    good = merkle.folded(proved, "leaf", "proof", "back")
    assert good.filter("back = root").count() == 10
    assert merkle.folded(proved.withColumn("leaf", F.sha2("leaf", 256)), "leaf", "proof", "back").filter("back = root").count() == 0
