"""The pipeline against a plain re-computation of its stages."""

import hashlib
import math
import os
import re
from collections import Counter, defaultdict

import duckdb
import pyarrow as pa
import pytest

import corpus_pipeline
from vellum.llm import oracles
from vellum.llm.ngram_join import ngram_components
from vellum.llm.queries import vocabulary

SF = "/root/testdata/sf0.001"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
STRIP = " \t\n\x0b\f\r"


def kept_by_rules(docs):
    con = duckdb.connect()
    con.register("documents", pa.Table.from_pylist(docs))
    kept = {r[0] for r in con.execute(f"SELECT doc_id FROM ({oracles.SQL['op3_quality_rules']}) WHERE kept").fetchall()}
    return [d for d in docs if d["doc_id"] in kept]


def without_common_lines(docs):
    holders = defaultdict(set)
    key = lambda line: line.strip(STRIP).translate(UP)
    for d in docs:
        for line in d["text"].split("\n"):
            if len(key(line)) >= 40:
                holders[key(line)].add(d["doc_id"])
    out = []
    for d in docs:
        lines = [x for x in d["text"].split("\n") if len(h := holders.get(key(x), ())) < 5 or max(h) == d["doc_id"]]
        out.append(d | {"text": "\n".join(lines)})
    return out


def first_of_near_copies(docs):
    sets, up = {}, {d["doc_id"]: d["doc_id"] for d in docs}
    for d in docs:
        w = WORDS.findall(d["text"].translate(UP))
        sets[d["doc_id"]] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in sets.items():
        for j, b in sets.items():
            if j < i and a and b and 100 * (n := len(a & b)) >= 80 * (len(a) + len(b) - n):
                x, y = root(i), root(j)
                up[max(x, y)] = min(x, y)
    return [d for d in docs if root(d["doc_id"]) == d["doc_id"]]


def mixed(docs):
    n, out = Counter(d["source"] for d in docs), []
    for d in docs:
        mean = len(docs) / (len(n) * n[d["source"]])
        assert mean <= 32
        u = int(hashlib.md5(f"mix|{d['doc_id']}|1".encode()).hexdigest()[:13], 16) / 2**52
        p = cdf = math.exp(-mean)
        k = 0
        while cdf <= u:
            k += 1
            p = p * mean / k
            cdf += p
        out += [d] * k
    return out


def test_run_same_as_plain_stages(spark):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{SF}/documents.parquet").toPandas().to_dict("records")
    for stage in (kept_by_rules, without_common_lines, first_of_near_copies, mixed):
        docs = stage(docs)
    t = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    want = Counter((d["doc_id"], d["source"], tuple(t.encode(d["text"], add_special_tokens=False).ids), hashlib.sha256(d["text"].encode()).hexdigest()) for d in docs)
    got = Counter((r["doc_id"], r["source"], tuple(r["ids"]), r["decoded_sha256"]) for r in corpus_pipeline.run(spark, SF).collect())
    assert got == want


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "lines", "near_duplicates", "mixing", "tokens"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(0), SF).columns == docs.columns
        assert stage(spark, docs.limit(0), SF).count() == 0


def test_near_duplicates_with_null_and_repeated_ids(spark):
    words = [f"w{i}" for i in range(60)]
    near = lambda i: " ".join(words[:i] + ["changed"] + words[i + 1 :])
    other, third = " ".join(words[::-1]), " ".join(f"v{i}" for i in range(30))
    rows = [(None, near(0)), (None, near(59)), (None, other), (None, other), (None, None), (None, ""), (5, " "), (5, " ")]
    rows += [(1, third), (1, third), (1, third + " more"), (2, third), (None, third), (3, "alone one two three four five"), (3, "alone six seven eight nine ten")]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    docs = spark.createDataFrame([(i, t, "en", f"s{k}", len(t or "")) for k, (i, t) in enumerate(rows)], schema)
    got = Counter((r["doc_id"], r["text"]) for r in corpus_pipeline.near_duplicates(spark, docs, SF).collect())
    assert [got.pop(x, 0) for x in [(None, near(0)), (None, near(59))]] in ([0, 1], [1, 0])
    assert [got.pop(x, 0) for x in [(1, third), (1, third + " more")]] in ([0, 1], [1, 0])
    assert got == Counter([(None, other), (None, None), (None, ""), (5, " "), (5, " "), rows[-2], rows[-1]])


def test_near_copies_of_null_ids_link(spark):
    words = [f"w{i}" for i in range(60)]
    begin, end = " ".join([*"pqrstu", *words[6:]]), " ".join([*words[:54], *"abcdef"])
    # 7 and 8 share 44 of 68 shingles; each shares 50 of 62 with the text whose rows have no id
    docs = spark.createDataFrame([(None, " ".join(words)), (None, " ".join(words)), (7, begin), (8, end), (9, "x y")], "doc_id bigint, text string")
    got = Counter((r["doc_id"], r["component_id"]) for r in ngram_components(docs).collect())
    assert got == Counter([(None, 7), (None, 7), (7, 7), (8, 7), (9, 9)])


@pytest.mark.parametrize("folder", ["vellum/llm", "corpus_pipeline.py"])
def test_entry_without(folder, tmp_path):
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(corpus_pipeline.__file__)
    for name in ("vellum", "__spark_entry__.py", "corpus_pipeline.py"):
        src = os.path.join(root, name)
        (shutil.copytree if os.path.isdir(src) else shutil.copy)(src, tmp_path / name)
    gone = tmp_path / folder
    shutil.rmtree(gone) if gone.is_dir() else gone.unlink()
    code = "import __spark_entry__ as e; q = e.queries(); assert 'block_summary' in q and 'pipeline' not in q and set(e.oracle_sql()) <= set(q)"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env=env, timeout=120)
