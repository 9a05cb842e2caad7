"""Merkle manifest, fill-in-middle and token counts against plain Python over the same rows, odd tables included."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessera.llm import fill_middle, merkle, token_counts
from tessera.llm.queries import WORD_VOCABULARY


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def rows_of(df, *columns):
    return Counter(tuple(row[c] for c in columns) for row in df.collect())


# --- fill-in-middle


def moved(doc_id, text, rate=100, suffix_first=50):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = sha(f"7:{'' if doc_id is None else doc_id}")
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    low, high = sorted(x % (len(units) + 1) for x in h[:2])
    prefix, middle, suffix = ("".join(units[a:b]) for a, b in ((0, low), (low, high), (high, None)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return doc_id, len(units), "plain", None, None, text
    if h[3] % 100 < suffix_first:
        return doc_id, len(units), "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return doc_id, len(units), "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


FIELDS = ("doc_id", "n", "form", "prefix_chars", "middle_chars", "output")


@pytest.fixture(scope="module")
def line_documents(spark):
    rng = random.Random(5)
    parts = ["a", "<", "P>", "<P", "é", "\n", "\n\n", "\r\n", "x y", "<<", "S>", "日本", "M", ">", "\x0b", "😀"]
    rows = [(k, "".join(rng.choice(parts) for _ in range(rng.randrange(0, 40)))) for k in range(600)]
    rows += [(600, None), (601, ""), (602, "\n"), (603, "no break"), (604, "a <P> b\nc"), (605, "line\n" * 50_000), (606, "x" * 300_000 + "\n" + "é" * 9), (3, "again\nand\nagain"), (3, "again\nand\nagain"), (None, "a\nb\nc\nd\n"), (None, None)]
    return spark.createDataFrame([(*r, "z", 5) for r in rows], "doc_id long, text string, n string, form int").repartition(5)


def test_lines_are_moved_as_the_plain_rule_says(line_documents):
    want = Counter(moved(r.doc_id, r.text) for r in line_documents.collect())
    assert rows_of(fill_middle.rearranged(line_documents), *FIELDS) == want
    assert {form for _, _, form, *_ in want} == {"plain", "spm", "psm"}


def test_rates_leave_some_texts_plain(line_documents):
    want = Counter(moved(r.doc_id, r.text, 60, 20) for r in line_documents.collect())
    assert rows_of(fill_middle.rearranged(line_documents, rate=60, suffix_first=20), *FIELDS) == want


def test_texts_are_restored_from_output_and_form(line_documents):
    out = fill_middle.rearranged(line_documents)
    back = Counter((r.doc_id, r.t) for r in out.select("doc_id", fill_middle.restored(F.col("output"), F.col("form")).alias("t")).collect())
    assert back == Counter((r.doc_id, r.text or "") for r in line_documents.collect())
    shown = rows_of(fill_middle.digests(out), "doc_id", "output_sha256", "restored_sha256")
    assert shown == Counter((r.doc_id, sha(moved(r.doc_id, r.text)[5]), sha(r.text or "")) for r in line_documents.collect())


def test_small_slices_change_nothing(line_documents, monkeypatch):
    before = rows_of(fill_middle.rearranged(line_documents), *FIELDS)
    batch = line_documents.select("doc_id", "text").toArrow().to_batches()[0]
    monkeypatch.setattr(fill_middle, "SLICE_BYTES", 64)
    parts = list(fill_middle._slices(batch, 1))
    assert sum(p.num_rows for p in parts) == batch.num_rows and len(parts) > 20
    assert rows_of(fill_middle.rearranged(line_documents), *FIELDS) == before


# --- Merkle manifest


def field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def proven(rows, arity=16):
    """Leaf by leaf: the tree rebuilt as lists, the proof read off level by level."""
    hashed = [(r, sha("".join(field(r[c]) for c in merkle.COLUMNS))) for r in rows]
    groups = defaultdict(list)
    for r, leaf in hashed:
        groups[r["source"]].append((r["doc_id"] is not None, r["doc_id"] or 0, leaf, r))
    up = lambda level: [sha("".join(level[k : k + arity])) for k in range(0, len(level), arity)]

    def levels(nodes):
        out = [nodes]
        while len(out[-1]) > 1:
            out.append(up(out[-1]))
        return out

    def climb(out, at, fold):
        proof = ""
        for level in out[:-1]:
            run = level[at // arity * arity : at // arity * arity + arity]
            k = at % arity
            proof += "".join(run[:k] + run[k + 1 :])
            fold, at = sha("".join([*run[:k], fold, *run[k + 1 :]])), at // arity
        return proof, fold

    sources = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    own = {s: levels([leaf for _, _, leaf, _ in sorted(groups[s], key=lambda x: x[:3])]) for s in sources}
    over = levels([own[s][-1][0] for s in sources])
    root = over[-1][0]
    for k, s in enumerate(sources):
        for at, (_, _, leaf, r) in enumerate(sorted(groups[s], key=lambda x: x[:3])):
            changed = dict(r)
            if r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 and r["text"] is not None:
                changed["text"] = re.sub("[A-Z]", lambda m: m[0].lower(), r["text"])
            low, fold = climb(own[s], at, sha("".join(field(changed[c]) for c in merkle.COLUMNS)))
            high, fold = climb(over, k, fold)
            yield r["doc_id"], leaf, own[s][-1][0], root, sha(low + high), fold, fold == root


PROOF = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
LEAVES = "doc_id long, text string, lang string, source string, n_chars long, leaf string, tree int"


def sized(spark, sizes):
    rng, k, rows = random.Random(9), 0, []
    for source, n in sizes:
        for _ in range(n):
            rows.append((k, f"Text {'É' * (k % 3)} {k} " if k % 4 else f"small {k}", "en" if k % 5 else None, source, k if k % 7 else None, "x", 1))
            k += 1
    rng.shuffle(rows)
    return spark.createDataFrame(rows, LEAVES).repartition(4)


@pytest.mark.parametrize("sizes", [[("a", 1)], [("a", 16)], [("a", 17)], [(None, 3), ("a", 1)], [("b", 273), ("a", 15), (None, 1), ("é", 2)], [(f"s{k}", 1 + k % 3) for k in range(40)]])
def test_proofs_equal_those_of_lists(spark, sizes):
    docs = sized(spark, sizes)
    assert rows_of(merkle.verify_documents(docs), *PROOF) == Counter(proven([r.asDict() for r in docs.collect()]))


def test_small_arity_makes_deep_trees_and_light_nodes(spark, monkeypatch):
    """With three children a node and nearly no heavy nodes, most steps of the climb are shuffled ones."""
    docs = sized(spark, [("a", 90), ("b", 11)])
    for share in (merkle.HEAVY_SHARE, 1):
        monkeypatch.setattr(merkle, "HEAVY_SHARE", share)
        got = rows_of(merkle.verify_documents(docs, arity=3), *PROOF)
        assert got == Counter(proven([r.asDict() for r in docs.collect()], arity=3))


def test_odd_documents_are_leaves_each(spark, odd_documents, no_documents):
    assert rows_of(merkle.verify_documents(odd_documents), *PROOF) == Counter(proven([r.asDict() for r in odd_documents.collect()]))
    assert merkle.verify_documents(no_documents).collect() == []


def test_tampering_is_what_proofs_tell(spark):
    docs = sized(spark, [("a", 60)])
    text = {r.doc_id: r.text for r in docs.collect()}
    for r in merkle.verify_documents(docs).collect():
        changed = zlib.crc32(str(r.doc_id).encode()) % 5 == 0 and text[r.doc_id] != text[r.doc_id].lower()
        assert r.verified == (not changed)
    assert spark.conf.get(merkle.ROW_LIMIT, None) is None  # the session is as before


# --- token counts


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def counts_of(library, docs, limit=2048):
    out = Counter()
    for r in docs.collect():
        n = len(library.encode(r.text or "", add_special_tokens=False).ids)
        out[r.doc_id, len((r.text or "").encode()), n, n > limit] += 1
    return out


TOKENS = ("doc_id", "n_bytes", "n_tokens", "over_limit")


@pytest.fixture(scope="module")
def worded_documents(spark):
    rng = random.Random(3)
    parts = ["the", "The", " ", "\n", "\t", "\x0b", "\x0c", "\x1c", "\x1f", "\x85", " ", " ", "　", "​", "é", "́", "É", "İ", "Σ", "ς", "don't", "'s", "'LL", "123", "٣", "<|endoftext|>", "<|ENDOFTEXT|>", "<|startoftext|>", "<|", "|>", "日本語", "😀", "!!", "...", "_", "ﬁ", "ẞ", "\x00", "x" * 70]
    rows = [(k, "".join(rng.choice(parts) for _ in range(rng.randrange(0, 60)))) for k in range(1500)]
    rows += [(2000, None), (2001, ""), (2002, " \n "), (2003, "the " * 5000), (2004, "z" * 40_000), (7, "again"), (7, "again"), (None, "null id"), (None, None)]
    return spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, n_tokens int, word string").repartition(4)


def test_counts_equal_the_librarys(library, worded_documents):
    assert rows_of(token_counts.count_tokens(worded_documents, WORD_VOCABULARY), *TOKENS) == counts_of(library, worded_documents)


def test_counts_of_the_smallest_table(spark, library):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert rows_of(token_counts.count_tokens(docs, WORD_VOCABULARY), *TOKENS) == counts_of(library, docs)


def test_counts_dont_depend_on_the_table(library, worded_documents, monkeypatch):
    """Without frequent words, with few, and with caches that overflow."""
    want = counts_of(library, worded_documents, limit=30)
    docs = worded_documents.limit(2000)
    for most in (0, 3):
        monkeypatch.setattr(token_counts, "frequent_words", lambda docs, most=most: [b"the", b"The", b"don't"][:most])
        assert rows_of(token_counts.count_tokens(docs, WORD_VOCABULARY, limit=30), *TOKENS) == want


def test_a_full_cache_starts_anew(library, monkeypatch):
    monkeypatch.setattr(token_counts, "REMEMBERED", 5)
    words = token_counts.Encoder(token_counts.read_vocabulary(WORD_VOCABULARY))
    import pyarrow as pa

    texts_ = [" ".join(f"w{k}x{j}" for j in range(9)) for k in range(20)]
    for text in texts_:
        (block,) = token_counts.texts.blocks(pa.array([text]))
        empty = token_counts.Lengths(np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64))
        assert token_counts.count_block(block, empty, words).tolist() == [len(library.encode(text, add_special_tokens=False).ids)]
        assert len(words.known) <= 5 + 9


def test_the_table_finds_what_it_holds():
    rng = np.random.default_rng(1)
    keys = rng.integers(1, 1 << 63, 5000, dtype=np.uint64) << np.uint64(3)  # crowded in their low bits
    keys = np.unique(keys)
    counts = rng.integers(1, 200, len(keys))
    table = token_counts.Lengths(keys, counts)
    found, known = table.find(keys)
    assert known.all() and (found == counts).all()
    assert not table.find(keys + np.uint64(1))[1].any()


def test_frequent_words_come_from_all_tasks(spark):
    docs = spark.createDataFrame([(f"often often rare{k} " + "often " * k,) for k in range(40)], "text string").repartition(8)
    assert token_counts.frequent_words(docs, 1) == [b"often"]


def test_empty_tables(no_documents):
    assert token_counts.count_tokens(no_documents, WORD_VOCABULARY).collect() == []
    assert fill_middle.rearranged(no_documents).collect() == []
