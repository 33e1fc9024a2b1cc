"""Queries against plain re-computations of their contracts, over whole tables at sf0.01."""

import hashlib
import math
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from vellum.llm import queries as q

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def docs(sf_dir):
    return pq.read_table(f"{sf_dir}/documents.parquet").to_pylist()


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def root_of(up, i):
    while up[i] != i:
        up[i] = up[up[i]]
        i = up[i]
    return i


def test_op1(spark, sf_dir, docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(q.vocabulary("byte_bpe_50k.json"))
    got = {r["doc_id"]: r for r in q.op1_bpe(spark, sf_dir).collect()}
    assert len(got) == len(docs)
    for d in docs:
        ids = t.encode(d["text"] or "", add_special_tokens=False).ids
        r = got[d["doc_id"]]
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), sha(",".join(map(str, ids))))
        assert r["decoded_sha256"] == sha(t.decode(ids, skip_special_tokens=False))


def test_op5(spark, sf_dir, docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(q.vocabulary("word_bpe_49k.json"))
    got = {r["doc_id"]: r for r in q.op5_token_files(spark, sf_dir).collect()}
    start = 0
    for d in sorted(docs, key=lambda d: d["doc_id"]):
        ids = [*t.encode(d["text"] or "", add_special_tokens=False).ids, 2]
        r = got[d["doc_id"]]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def all_code_points():
    """Every code point of the first two planes and some of the others, beside letters, digits, marks, white space and an apostrophe."""
    points = [chr(c) for c in (*range(0x20000), *range(0x20000, 0x110000, 41)) if not 0xD800 <= c < 0xE000]
    return [f"&{c}a '{c}s1{c}{c}" for c in points]


def mixed_texts(n):
    """Random strings of what a split may get wrong."""
    rnd = random.Random(1)
    parts = [*"aAsStrevmld'' \t\n 1½٣!?-éßİſK", "\u0301", "\u3000", "中", "한", "ᅡ", "<|endoftext|>", "<|", "'s", "'re", "'ll", "'LL", "Σ", "ΑΣ", "𝐀", "😀", "\0", "\x85", "\x1c", "  ", "\u00a0"]
    return ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 14))) for _ in range(n)]


def test_op5_split():
    from vellum.llm.pieces import byte_blocks, table, text_bytes
    from vellum.llm.token_files import Words

    path = q.vocabulary("word_bpe_49k.json")
    words, texts = Words(path, table(path)), all_code_points() + mixed_texts(20_000)
    data, rows = text_bytes(pa.array(texts))
    sizes, ids = zip(*(words.encode(data[rows[a] : rows[b]], rows[a : b + 1] - rows[a]) for a, b in byte_blocks(rows)), strict=True)
    want = [e.ids for e in words.whole.encode_batch_fast(texts, add_special_tokens=False)]
    assert np.concatenate(sizes).tolist() == list(map(len, want))
    assert np.concatenate(ids).tolist() == [i for x in want for i in x]


def test_op1_split():
    from tokenizers import Tokenizer

    from vellum.llm.bpe import Bpe
    from vellum.llm.pieces import byte_blocks, table, text_bytes

    path = q.vocabulary("byte_bpe_50k.json")
    words, texts = Bpe(path, table(path)), all_code_points() + mixed_texts(20_000)
    data, rows = text_bytes(pa.array(texts))
    sizes, ids = zip(*(words.encode(data[rows[a] : rows[b]], rows[a : b + 1] - rows[a]) for a, b in byte_blocks(rows)), strict=True)
    want = [e.ids for e in Tokenizer.from_file(path).encode_batch_fast(texts, add_special_tokens=False)]
    assert np.concatenate(sizes).tolist() == list(map(len, want))
    assert np.concatenate(ids).tolist() == [i for x in want for i in x]


def test_op6(spark, sf_dir, docs):
    got = {r["doc_id"]: r for r in q.op6_sharding(spark, sf_dir).collect()}
    rows = sorted((d["doc_id"], (d["text"] or "").encode()) for d in docs)
    total, start, slots = sum(len(t) + 8 for _, t in rows), 0, defaultdict(int)
    for i, text in rows:
        r, shard = got[i], start * 24 // total
        assert (r["size"], r["text_crc32"], r["shard"], r["slot"], r["law"], r["grown_shard"]) == (len(text) + 8, zlib.crc32(text), shard, slots[shard], "bytes", None)
        slots[shard] += 1
        start += len(text) + 8
    assert set(slots) == set(range(24))


def word_sets(docs):
    sets = {}
    for d in docs:
        w = WORDS.findall((d["text"] or "").translate(UP))
        sets[d["doc_id"]] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    return sets


def test_op7(spark, sf_dir, docs):
    sets = word_sets(docs)
    up = {i: i for i in sets}
    lists = defaultdict(list)
    for i in sorted(sets):
        shared = defaultdict(int)
        for s in sets[i]:
            for j in lists[s]:
                shared[j] += 1
            lists[s].append(i)
        for j, n in shared.items():
            if 100 * n >= 80 * (len(sets[i]) + len(sets[j]) - n):
                a, b = root_of(up, i), root_of(up, j)
                up[max(a, b)] = min(a, b)
    want = {i: (len(s), root_of(up, i)) for i, s in sets.items()}
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in q.op7_ngram_join(spark, sf_dir).collect()}
    assert got == want
    assert sum(i != c for i, (_, c) in want.items()) > 20


def test_op8(spark, sf_dir):
    rows = pq.read_table(f"{sf_dir}/embeddings.parquet").to_pylist()
    x = np.array([r["embedding"] for r in rows], np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    label = np.array([r["label"] for r in rows])
    true = (x @ x.T >= 0.98) & (label[:, None] == label[None]) & ~np.eye(len(rows), dtype=bool)
    got = {r["vec_id"]: r for r in q.op8_embedding_dedup(spark, sf_dir).collect()}
    ids = [r["vec_id"] for r in rows]
    found = np.array([got[i]["n_links"] for i in ids])
    assert (found <= true.sum(1)).all()
    assert found.sum() >= 0.9 * true.sum()
    up = {i: i for i in ids}
    for a, b in zip(*np.nonzero(true), strict=True):
        i, j = root_of(up, ids[a]), root_of(up, ids[b])
        up[max(i, j)] = min(i, j)
    same = [got[i]["component_id"] == root_of(up, i) for i in ids]
    assert np.mean(same) >= 0.95
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got.values())


def test_op8_recall_on_planted_pairs(spark, sf_dir, tmp_path):
    table = pq.read_table(f"{sf_dir.replace('0.01', '0.1')}/embeddings.parquet").select(["vec_id", "embedding", "label"])
    x = np.array(table["embedding"].to_pylist(), np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    label, rng = np.array(table["label"].to_pylist()), np.random.default_rng(11)
    at, cosine = rng.choice(len(x), 1500, replace=False), rng.uniform(0.975, 1, 1500)
    u = rng.normal(size=(1500, x.shape[1]))
    u -= (u * x[at]).sum(1, keepdims=True) * x[at]
    mates = cosine[:, None] * x[at] + np.sqrt(1 - cosine**2)[:, None] * u / np.linalg.norm(u, axis=1, keepdims=True)
    x, label = np.concatenate([x, mates]).astype(np.float32), np.concatenate([label, label[at]])
    pq.write_table(pa.table({"vec_id": np.arange(len(x)), "embedding": pa.array(list(x), pa.list_(pa.float32())), "label": pa.array(label, pa.int32())}), tmp_path / "embeddings.parquet")
    y = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    true = (y @ y.T >= 0.98) & (label[:, None] == label[None]) & ~np.eye(len(x), dtype=bool)
    got = {r["vec_id"]: r["n_links"] for r in q.op8_embedding_dedup(spark, str(tmp_path)).collect()}
    found = np.array([got[i] for i in range(len(x))])
    print("true links", true.sum() // 2, "found", found.sum() // 2)
    assert true.sum() >= 2 * 1000
    assert (found <= true.sum(1)).all()
    assert found.sum() >= 0.98 * true.sum()


def test_op9(spark, sf_dir, docs):
    assign = re.compile(r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD])|(?:[pP][aA][sS][sS][wW][dD])|(?:[sS][eE][cC][rR][eE][tT])|(?:[tT][oO][kK][eE][nN])|(?:[aA][pP][iI]_?[kK][eE][yY]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    got = {r["doc_id"]: r for r in q.op9_secrets(spark, sf_dir).collect()}
    for d in docs:
        t = d["text"] or ""
        found = [(m.start(), 0, m.end()) for m in assign.finditer(t) if len(m[2]) >= 8]
        found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
        found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 32]
        r = got[d["doc_id"]]
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(k == x for _, k, _ in found) for x in range(3)]
        listed = ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in sorted(found))
        assert r["base_sha256"] == sha(listed)
        assert set(filter(None, listed.split(","))) <= set(filter(None, r["spans"].split(",")))


def test_op10_held_out(spark, sf_dir):
    big = sf_dir.replace("0.01", "0.1")
    label = {r["doc_id"]: r["toxic"] for r in pq.read_table(f"{big}/labels.parquet").to_pylist()}
    got = [r for r in q.op10_toxicity(spark, big).collect() if r["held_out"] and label.get(r["doc_id"]) is not None]
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 for r in got)
    hit = sum(r["predicted"] and label[r["doc_id"]] for r in got)
    # measured: recall 0.93, precision 0.99; one toxic label in twenty is on a text without any marking word
    assert hit >= 0.90 * sum(label[r["doc_id"]] for r in got)
    assert hit >= 0.95 * sum(r["predicted"] for r in got)
    assert all(0 <= r["score"] <= 1 and not math.isnan(r["score"]) for r in got)


def test_op10_plain():
    """Scores and spans of a small field by enumeration of all tags, word by word."""
    from itertools import product

    from vellum.llm import toxicity as t

    rnd, letter = random.Random(5), re.compile(r"[^\W\d_]+")
    field = t.Field({"vile": 3.0, "rott-": 2.0, "scum": 5.0}, np.array([-2.0, 0.9, 1.1, 0.3, -0.2, 0.4]), np.array([[0.5, -0.4], [-0.3, 0.6]]), np.array([-2.0, 3.0, 0.7, 0.1]))
    texts = [" ".join(rnd.choice(["a", "Vile", "VILE", "rotten,", "Rottweil", "scum!", "é-ü", "x1y", "ÀB"]) for _ in range(rnd.randint(0, 5))) for _ in range(60)]
    for text, (score, spans) in zip(texts, t.score_texts(texts, field), strict=True):
        found = list(letter.finditer(text))
        if not found:
            assert (score, spans) == (0.0, [])
            continue
        words = [m[0].lower() for m in found]
        ratio = [(field.words.get(w, 0.0), max([field.words.get(f"{w[:k]}-", 0.0) for k in t.STEMS if k <= len(w)] or [0.0])) for w in words]
        most = [0.0, *map(max, ratio), 0.0]
        emit = [np.dot(field.emit, [1, *ratio[i], most[i], most[i + 2], float(most[i + 1] > 0 and len(m[0]) > 1 and m[0][:2].isupper())]) for i, m in enumerate(found)]
        total, on = 0.0, np.zeros(len(words))
        for tags in product((0, 1), repeat=len(words)):
            w = math.exp(sum(e for e, k in zip(emit, tags, strict=True) if k) + sum(field.move[a, b] for a, b in zip(tags, tags[1:], strict=False)))
            total += w
            on += w * np.array(tags)
        m = on / total
        top = sorted(m)[-3:]
        z = [1.0, 1 - math.prod(1 - x for x in top), math.log1p(m.sum()), min(5.0, 100 * m.sum() / len(m))]
        assert math.isclose(score, 1 / (1 + math.exp(-np.dot(field.document, z))), rel_tol=1e-9)
        assert spans == [x.span() for x, p in zip(found, m, strict=True) if p >= 0.5 and score >= 0.5]
