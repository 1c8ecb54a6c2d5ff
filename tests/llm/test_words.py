"""Toxicity, spelling variants and token alignment, against brute-force versions."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.llm import alignment, toxicity, variants


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_automaton_is_the_nearest_term_within_its_edits():
    r = np.random.default_rng(3)
    terms = {"".join(r.choice(list("abcd"), n)): True for n in (3, 4, 5, 5, 6, 8, 9, 10) for _ in range(3)}
    automaton = toxicity.Automaton(terms, most=200)
    for _ in range(4000):
        t = list(r.choice(sorted(terms)))
        for _ in range(r.integers(0, 4)):
            i = r.integers(0, len(t) + 1)
            t[i : i + r.integers(0, 2)] = list(r.choice(list("abcde"), r.integers(0, 2)))
        word = "".join(t)
        begun = max((x for x in terms if word.startswith(x)), key=len, default=None)
        near = min(((distance(word, x), x) for x in terms if distance(word, x) <= toxicity.edits(x)), default=None)
        assert automaton.find(word) == ((begun, 0) if begun else near and near[::-1]), word


def test_stems_begin_a_word_as_they_are():
    a = toxicity.Automaton({"grumbl": False, "dolt": True})
    assert [a.find(w) for w in ("grumbling", "grumbl", "grambling", "grumb", "dolts", "dolty", "dol")] == [("grumbl", 0), ("grumbl", 0), None, None, ("dolt", 0), ("dolt", 0), None]


def test_misspelled_terms_and_quotation():
    reader = toxicity.Reader(toxicity.Model({"numpty": (1.0, True), "wazzock": (1.0, True)}, frozenset({"wazzocks", "numpy"}), (2.0, 0.5, -2.0)))
    found = lambda t: [(t[s:e], term, k) for s, e, term, k, _ in reader.hits(t)]
    assert found("You NUMPTY, you nump7y! a num_pty, nuuuumpty; numpy wazz0ck") == [("NUMPTY", "numpty", 0), ("nump7y", "numpty", 0), ("num_pty", "numpty", 1), ("nuuuumpty", "numpty", 1), ("wazz0ck", "wazzock", 0)]
    abuse = lambda t: reader.hits(t)[0][4]
    assert abuse("you are a numpty") > abuse("the crowd, a numpty among them") - 1e-9 > abuse('he wrote of the word "numpty" in a letter')
    assert abuse('the word "numpty" means a fool') < 0.2 and abuse("“numpty” is old") < 0.7
    assert [r[:2] for r in reader.hits("İ numpty 😀 numpty")] == [(2, 8), (11, 17)]
    assert reader.features("x " * 50, []) == (0.0, 0.0)
    line = "you numpty of a man, go home and stay there tonight\n"
    assert reader.features(line * 5, reader.hits(line * 5))[0] < 2 * reader.features(line, reader.hits(line))[0]


@pytest.fixture(scope="module")
def abuse(spark):
    """Documents with an insult of four languages' kinds: whole words, and a stem with endings that vary."""
    r = np.random.default_rng(5)
    words = ["".join(r.choice(list("aeioumnrstl"), r.integers(3, 8))) for _ in range(400)]
    insults, rows = ["gobdaw", "bellend", "muppet"], []
    for i in range(900):
        text = list(r.choice(words, 60))
        if i % 6 == 0:
            for k in range(3):
                text[r.integers(0, 60)] = insults[(i // 6 + k) % 3] if i % 12 else "grockle" + str(r.choice(words))
        rows.append((i, " ".join(text), int(i % 6 == 0)))
    rows += [(i, "the same passage with a strangeword in it for all to read " * 2, 1) for i in range(2000, 2030)]
    return spark.createDataFrame(rows, "doc_id long, text string, label int")


def test_toxicity(spark, abuse, documents):
    model = toxicity.train(abuse.where("doc_id % 5 <> 0"))
    assert {"gobdaw", "bellend", "muppet"} <= set(model.terms) and any("grockle".startswith(t) or t.startswith("grock") for t in model.terms)
    assert not any(t.startswith("strang") for t in model.terms)  # a copied passage has one surrounding
    got = toxicity.toxicity(abuse, model).join(abuse.where("doc_id < 1000"), "doc_id").collect()
    assert len(got) == 900 and all(r["predicted"] == r["label"] for r in got) and all(0 <= r["score"] <= 1 for r in got)
    odd = [(1, None), (2, ""), (3, "x" * 1_200_000), (4, "gobdaw " * 30_000), (None, "you gobdaw"), (4, "gobdaw " * 30_000), (5, "1 2 3 " * 200_000)]
    rows = toxicity.toxicity(documents(odd), model).collect()
    by = {r["doc_id"]: r for r in rows}
    assert len(rows) == 7 and by[1]["score"] == by[2]["score"] == by[3]["score"] < 0.5 and by[4]["n_terms"] == 30_000
    assert toxicity.toxicity(documents([(1, "x")]).limit(0), model).collect() == []


@pytest.mark.parametrize("labels", [[], [0, 0], [1]])
def test_toxicity_without_two_labels(spark, documents, labels):
    model = toxicity.train(spark.createDataFrame([(i, "some words here", y) for i, y in enumerate(labels)], "doc_id long, text string, label int"))
    assert [r["predicted"] for r in toxicity.toxicity(documents([(1, "some words"), (2, None)]), model).collect()] == [int(labels != [0, 0])] * 2


def grouped(rows, noise, letters=6, least=5, times=5):
    n = Counter()
    for i, text in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(c.lower() if c.isascii() else c for c in w)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if noise and h % noise == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            n[w] += 1
    words = {w: k for w, k in n.items() if len(w) >= letters and k >= least}
    near = {w: [x for x in words if abs(len(x) - len(w)) < 2 and x != w and distance(w, x) == 1] for w in words}
    form = {w: min(near[w], key=lambda x: (-words[x], x), default=None) for w in words}
    form = {w: f if f and words[f] >= times * words[w] else None for w, f in form.items()}

    def root(w):
        return root(form[w]) if form[w] else w

    return {(w, form[w], root(w), words[w], len(near[w]), words[form[w]] if form[w] else None) for w in words}


def test_variants(documents, monkeypatch):
    r, rows = np.random.default_rng(7), []
    monkeypatch.setattr(variants, "LONG", 9)
    base = ["abcabc", "aabbcc", "abcdefgh", "éàbcdeé", "aaaaaaa", "abcdefghijkl", "ÿ×÷ßabc"]
    for i in range(400):
        words = []
        for _ in range(30):
            w = list(base[min(int(r.exponential(1.5)), 6)])
            for _ in range(int(r.exponential(0.6))):
                at = r.integers(0, len(w) + 1)
                w[at : at + r.integers(0, 2)] = list(r.choice(list("abcÉ"), r.integers(0, 2)))
            words.append("".join(w))
        rows.append((i, " ".join(words).replace("abcdef", "ABCDEF") if i % 2 else "1".join(words)))
    rows += [(2000, "zzcdef " * 125 + "zzcdeg " * 25 + "zzcdhg " * 5), (1000, None), (1001, ""), (None, rows[0][1]), (5, rows[0][1]), (5, rows[0][1])]
    for noise in (None, 7):
        got = variants.variants(documents(rows), noise=noise).collect()
        assert len(got) == len({r["word"] for r in got}) > 50 and {tuple(r) for r in got} == grouped(rows, noise)
    assert {r["word"]: r["root"] for r in variants.variants(documents(rows)).collect()}["zzcdhg"] == "zzcdef"


def test_variants_of_very_long_words_and_no_words(documents):
    long = "ab" * 600_000
    rows = [(i, f"{long} {long[:-1]}") for i in range(5)] + [(9, long[:-1] + "c")]
    got = {len(r["word"]): r for r in variants.variants(documents(rows)).collect()}
    assert set(got) == {1_200_000, 1_199_999} and all(r["n_near"] == 1 and r["n"] == 5 and r["form"] is None for r in got.values())
    assert variants.variants(documents([(1, None), (2, "")])).collect() == [] == variants.variants(documents([(1, "x")]).limit(0)).collect()


def test_unequal_strings_of_one_key_are_taken_apart():
    rows = variants.met(np.array([5, 5, 5]), np.array([0, 0, -1]), np.array([True] * 3), ["xabcde", "yabcde", "qqqqqq"], np.array([9, 2, 7]))
    assert sorted(rows) == [("xabcde", 1, 2, "yabcde"), ("yabcde", 1, 9, "xabcde")]


def test_deletion_keys_are_those_of_the_strings():
    words = ["aabbcc", "abbcc", "éaaé", "x", ""]
    number, at, key, last = variants.deletion_keys(words)
    by = {}
    for n, p, k in zip(number, at, key):
        w = words[n]
        by.setdefault(w if p < 0 else w[:p] + w[p + 1 :], set()).add(k)
    assert all(len(k) == 1 for k in by.values()) and len({next(iter(k)) for k in by.values()}) == len(by)
    assert [bool(x) for x in last[len(words) : len(words) + 6]] == [False, True] * 3


def test_links_of_tokens_that_end_together():
    """Also where tokens have no bytes, so that several end at one cut."""
    r = np.random.default_rng(2)
    size = np.array([0, 1, 1, 2, 3])
    for _ in range(200):
        a, b = r.integers(0, 5, 12), r.integers(0, 5, 12)
        short = int(min(size[a].sum(), size[b].sum()))
        a, b = (np.append(x[np.cumsum(size[x]) <= short], np.ones(short - int(size[x][np.cumsum(size[x]) <= short].sum()), int)) for x in (a, b))
        n, group_a, group_b, cut, link_a, link_b = alignment.aligned(a, b, size, size)
        ends_a, ends_b = np.cumsum(size[a]), np.cumsum(size[b])
        want = [(x, y) for x, e in zip(a, ends_a) for y, f in zip(b, ends_b) if e == f]
        assert sorted(zip(link_a, link_b)) == sorted(want) and n == len(set(ends_a) & set(ends_b))
        cuts = sorted(set(ends_a) & set(ends_b))
        assert [sum(c < e for c in cuts) for e in ends_a] == list(group_a) and [sum(c < e for c in cuts) for e in ends_b] == list(group_b)


def brute(rows):
    import public_tokenizers as P
    import sentencepiece
    from tokenizers import Tokenizer
    from tokenizers.pre_tokenizers import ByteLevel

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    s = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    plain = [b for b in range(256) if chr(b) in ByteLevel.alphabet() and (33 <= b < 127 or b > 160)]
    letter = dict(zip(map(chr, plain), plain)) | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
    out, count = [], Counter()
    for i, text in rows:
        found = None
        if text:
            a, b = t.encode(" " + text, add_special_tokens=False), s.encode(text)
            of_a = [bytes(letter[c] for c in x) for x in a.tokens]
            of_b = [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x..>", p) else p.replace("▁", " ").encode() for p in s.id_to_piece(b)]
            if b"".join(of_a) == b"".join(of_b) == (" " + text).encode():
                ends_a, ends_b = (list(np.cumsum([len(x) for x in v])) for v in (of_a, of_b))
                cuts, groups, links = sorted(set(ends_a) & set(ends_b)), [], []
                for lo, hi in zip([0, *cuts], cuts):
                    of = lambda ids, ends: ",".join(str(x) for x, e in zip(ids, ends) if lo < e <= hi)  # noqa: E731, B023
                    groups.append(of(a.ids, ends_a) + "|" + of(b, ends_b))
                    links.append((a.ids[ends_a.index(hi)], b[ends_b.index(hi)]))
                found = (len(a.ids), len(b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest())
                count.update(links)
        out.append((i, found))
    best = {b: max(n for (_, y), n in count.items() if y == b) for _, b in count}
    return Counter((i, 0, 0, 0, 0, 0, 0, "") if x is None else (i, *x[:3], len(x[3]), sum(count[k] == best[k[1]] for k in x[3]), sum(count[k] for k in x[3]), x[4]) for i, x in out)


@pytest.mark.parametrize("head", [0, 20, 1 << 18])
def test_alignment(spark, documents, prose, head, monkeypatch, tmp_path):
    monkeypatch.setattr(alignment, "HEAD", head)
    rows = [(i, prose(i, 40)) for i in range(20)] + [(30, None), (31, ""), (32, " two  blanks"), (33, "tab\tand\nline"), (34, "<|endoftext|> is text"), (35, "naïve 漢字 😀 ½ ﬁ"), (36, "▁ mark"), (37, "x" * 1500), (38, prose(1, 600)), (5, prose(5, 40)), (None, "no id"), (39, "é é Å"), (40, "end ")]
    docs = documents(rows)
    found = alignment.align(docs, keep_groups=True)
    sums = alignment.linked(found, alignment.pair_counts(found))
    got = found.join(sums, "row").select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "groups").collect()
    assert Counter(tuple(r)[:-1] for r in got) == brute(rows)
    assert all(r["groups_sha256"] == (hashlib.sha256(r["groups"].encode()).hexdigest() if r["groups"] else "") for r in got)


def test_alignment_of_an_empty_table(documents):
    found = alignment.align(documents([(1, "x")]).limit(0))
    assert alignment.linked(found, alignment.pair_counts(found)).collect() == []


def test_salted_sums_are_the_sums(spark, documents, monkeypatch):
    monkeypatch.setattr(alignment, "HELD", 4)
    found = alignment.align(documents([(i, "one two three four five") for i in range(50)], parts=5))
    pairs = alignment.pair_counts(found)
    assert {r["n"] for r in pairs.collect()} == {50} and pairs.where(~F.col("best")).isEmpty()
