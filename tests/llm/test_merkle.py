from hashlib import sha256
from zlib import crc32

import pytest
from pyspark.sql import functions as F

from quillmine.llm import merkle
from quillmine.llm.queries_merkle import op11_merkle_manifest
from tests.llm.helpers import frame, odd_docs


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def levels(leaves):
    out = [leaves]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][i : i + 8]) for i in range(0, len(out[-1]), 8)])
    return out


def path(tree, at):
    out = []
    for nodes in tree[:-1]:
        run = at - at % 8
        out.append(("".join(nodes[run:at]), "".join(nodes[at + 1 : run + 8])))
        at //= 8
    return out


def brute(rows):
    """(doc_id, source, lang, n_chars, text) -> the query's rows."""
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r, text: h(*map(field, (*r[:4], text)))
    low = lambda t: t if t is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in t)
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = []
    for g in names:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[4])))
        trees.append(levels([leaf(r, r[4]) for r in groups[g]]))
    whole = levels([t[-1][0] for t in trees])
    out = []
    for k, g in enumerate(names):
        for at, r in enumerate(groups[g]):
            proof = path(trees[k], at) + path(whole, k)
            node = leaf(r, low(r[4])) if r[0] is not None and crc32(str(r[0]).encode()) % 3 == 0 else leaf(r, r[4])
            for a, b in proof:
                node = h(a, node, b)
            out.append((r[0], leaf(r, r[4]), trees[k][-1][0], whole[-1][0], h(*(a + b for a, b in proof)), node, node == whole[-1][0]))
    return sorted(out, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))


def query(spark, docs, tmp_path):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    return op11_merkle_manifest(spark, str(tmp_path))


@pytest.mark.parametrize("layer", [1, 2, 3])
@pytest.mark.parametrize("n", [1, 2, 8, 9, 63, 64, 65, 512, 600, 4095, 4096])
def test_traversal_emits_every_path(n, layer):
    leaves = [h(str(i)) for i in range(n)]
    tree = levels(leaves)
    walk = merkle.Traversal(leaves.__getitem__, n, merkle.height(n), layer)
    assert walk.root == tree[-1][0]
    assert list(walk.paths()) == [path(tree, i) for i in range(n)]


def test_traversal_holds_few_nodes():
    n, most = 4096, 0
    walk = merkle.Traversal(str, n, 4)
    for _ in walk.paths():
        most = max(most, sum(len(x) for t in (*walk.existing, *walk.desired) for x in (*t.levels, *t.pending)))
    assert most < 4 * 73 + 64  # two subtrees of 73 nodes a layer, and runs not full yet


def test_blocks_of_a_large_tree(spark):
    """Blocks of 64 leaves, so that there are three tiers, with an uneven end and groups of one row."""
    counts = {"a": 4200, "b": 1, "c": 65, None: 64}
    rows = [(i, g, h(f"{g}{i}")) for g, n in counts.items() for i in range(n)]
    df = spark.createDataFrame(rows, "i int, g string, leaf string").repartition(5)
    found = merkle.manifest(df, F.col("g"), [F.col("i")], F.col("leaf"), levels=2).collect()
    names = [None, "a", "b", "c"]
    trees = {g: levels([x for _, k, x in sorted((r for r in rows if r[1] == g), key=lambda r: r[0])]) for g in names}
    whole = levels([trees[g][-1][0] for g in names])
    assert len(found) == len(rows)
    for r in found:
        assert (r.subroot, r.root) == (trees[r.g][-1][0], whole[-1][0])
        assert [tuple(x) for x in r.proof] == path(trees[r.g], r.i) + path(whole, names.index(r.g))


def test_odd_rows(spark, tmp_path):
    docs = odd_docs(spark)
    rows = [tuple(r[c] for c in ("doc_id", "source", "lang", "n_chars", "text")) for r in docs.collect()]
    out = query(spark, docs, tmp_path)
    assert out.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert got(out) == brute(rows)


def test_one_row_and_none(spark, tmp_path):
    one = got(query(spark, frame(spark, ["A b"]), tmp_path / "one"))
    assert len(one) == 1 and one[0][1] == one[0][2] == one[0][3]
    assert query(spark, frame(spark, ["a"]).limit(0), tmp_path / "none").count() == 0


def test_columns_that_clash_are_replaced(spark):
    df = spark.createDataFrame([(1, "a", "x", 5, "y")], "i int, g string, leaf string, pos int, proof string")
    r = merkle.manifest(df, F.col("g"), [F.col("i")], F.col("leaf")).collect()
    assert r[0].asDict() == {"i": 1, "g": "a", "leaf": "x", "node": "x", "subroot": "x", "root": "x", "proof": []}


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "source", "lang", "n_chars", "text").collect()]
    found = got(op11_merkle_manifest(spark, sf))
    assert found == brute(rows)
    assert 0.2 < sum(not r[-1] for r in found) / len(found) < 0.4
