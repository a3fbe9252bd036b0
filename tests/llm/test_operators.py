"""Each training-data operator against a brute-force version, an exact round trip, or held-out accuracy, with odd rows."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from ragloom.llm import boosting, bpe, chat, common, embeddings, packing, personal_data, quality_classifier, quality_rules, simhash, substrings, wordpiece

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [None, "", " \n\t", "one", "a b c d e f g", "x " * 400, "the same five words here and " * 30, "é" * 3000, "ab\n" * 500, "😀 mixed\x0bspace\x0cwords", "line\nline\nother\n\nline"]


def documents(spark, texts, extra=True):
    cols = [(i, t, "zz") for i, t in enumerate(texts)]
    df = spark.createDataFrame(cols, "doc_id long, text string, seed string")
    return df.withColumn("words", F.lit(1)).withColumn("fp", F.lit("x")) if extra else df.drop("seed")


def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string")


def corpus(seed=1, n=60):
    r = random.Random(seed)
    words = ["".join(r.choice("abcdeghinorst") for _ in range(r.randint(2, 8))) for _ in range(250)]
    text = lambda k: " ".join(r.choice(words) for _ in range(k))
    out = list(ODD)
    for i in range(n):
        t = text(r.randint(5, 200)) + "."
        out.append(t)
        if i % 4 == 0:
            out.append(t.upper() if i % 8 else t)
        if i % 5 == 0:
            out.append(t + " " + text(2))
    return out


# 1 ------------------------------------------------------------------------------------------------------------------


def counts(text):
    w = WORD.findall(text or "")
    grams = collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    cover, seen, dup = set(), set(), 0
    for i in range(len(w) - 4):
        if grams[tuple(w[i : i + 5])] > 1:
            cover.update(range(i, i + 5))
    for ln in (text or "").split("\n"):
        if WORD.search(ln):
            dup += ln in seen
            seen.add(ln)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(cover)


def vote_model(patterns, n_rules):
    """The same estimate in numpy."""
    q = quality_rules
    cells = np.array([p[0] for p in patterns])
    n = np.array([float(p[1]) for p in patterns])
    total, w = n.sum(), n.sum() * q.PRIOR_WEIGHT + 1
    pg, pb, share = np.tile(q.GOOD_VOTES, n_rules), np.tile(q.BAD_VOTES, n_rules), q.GOOD_SHARE

    def post():
        return 1 / (1 + (1 - share) / share * np.exp(np.log(pb[cells]).sum(1) - np.log(pg[cells]).sum(1)))

    for _ in range(q.ROUNDS):
        p = post()
        g, b = np.zeros(3 * n_rules), np.zeros(3 * n_rules)
        for row, x, y in zip(cells, n * p, n * (1 - p)):
            g[row] += x
            b[row] += y
        good, k = (n * p).sum(), q.GOOD_SHARE
        pg = (g + w * k * np.tile(q.GOOD_VOTES, n_rules)) / (good + w * k)
        pb = (b + w * (1 - k) * np.tile(q.BAD_VOTES, n_rules)) / (total - good + w * (1 - k))
        share = (good + w * k) / (total + w)
    return post()


def test_quality_rules(spark):
    texts = corpus() + ["w%%% x&&& " * 20, "a | b | " * 30]
    got = {r.doc_id: r for r in quality_rules.judge(documents(spark, texts)).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        want = counts(t)
        assert tuple(got[i][c] for c in quality_rules.COUNTS) == want
        failed = want[0] < 10 or 100 * want[4] > 20 * want[0]
        assert got[i].base_failed == failed and not (failed and got[i].kept)
    assert quality_rules.judge(empty(spark)).count() == 0


def test_vote_model(spark):
    r = random.Random(5)
    n_rules = 4
    patterns = [([3 * k + r.choice((0, 1, 2, 2)) for k in range(n_rules)], r.randint(1, 50)) for _ in range(12)]
    patterns = list({tuple(c): (c, n) for c, n in patterns}.values())
    df = spark.createDataFrame(patterns, "cells array<int>, n long")
    got = {tuple(x.cells): x.p_good for x in quality_rules.vote_model(df, n_rules).collect()}
    for (c, _), p in zip(patterns, vote_model(patterns, n_rules)):
        assert got[tuple(c)] == pytest.approx(p, abs=1e-9)


def test_quality_rules_keep_clean_and_use_no_python(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    x = quality_rules.judge(docs).where("not base_failed").join(labels, "doc_id").groupBy("quality", "kept").count().collect()
    n = {(r.quality, r.kept): r["count"] for r in x}
    assert n.get((1, False), 0) == 0 and n.get((0, False), 0) > n.get((0, True), 0)
    plan = quality_rules.text_counts(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_quality_verdicts(spark):
    """``p_good`` and ``kept`` of every document beside the model in numpy."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rules = quality_rules.rules()
    votes = quality_rules.text_counts(docs).select("doc_id", F.array(*[F.lit(3 * k) + v for k, v in enumerate(rules.values())]).alias("c")).collect()
    cells = {r.doc_id: tuple(r.c) for r in votes}
    patterns = sorted(collections.Counter(cells.values()).items())
    p_good = dict(zip([c for c, _ in patterns], vote_model([(list(c), n) for c, n in patterns], len(rules))))
    for r in quality_rules.judge(docs).collect():
        assert r.p_good == pytest.approx(p_good[cells[r.doc_id]], abs=1e-9)
        assert r.kept == (not r.base_failed and r.p_good >= quality_rules.KEEP_AT)


# 2 ------------------------------------------------------------------------------------------------------------------


def brute_print(text):
    import xxhash

    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = WORD.findall(lower)
    if not w:
        return 0
    sh = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))]
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def components(ids, linked):
    root = {i: i for i in ids}
    while True:
        new = {i: min([root[i], *(root[j] for j in linked[i])]) for i in ids}
        if new == root:
            return root
        root = new


def test_simhash(spark):
    texts = corpus(2)
    prints = [brute_print(t) for t in texts]
    linked = {i: [j for j in range(len(texts)) if j != i and (prints[i] ^ prints[j]).bit_count() <= 4] for i in range(len(texts))}
    root = components(range(len(texts)), linked)
    got = {r.doc_id: r for r in simhash.near_duplicates(documents(spark, texts)).collect()}
    assert len(got) == len(texts)
    for i in range(len(texts)):
        assert (got[i].fingerprint, got[i].component_id) == (f"{prints[i]:016x}", root[i])
    assert simhash.near_duplicates(empty(spark)).count() == 0
    docs = documents(spark, texts)
    kept = [r.doc_id for r in simhash.representatives(docs).collect()]
    assert sorted(kept) == sorted(set(root.values()))
    unnamed = docs.where("doc_id = 12").withColumn("doc_id", F.lit(None).cast("long"))
    odd = docs.unionByName(docs.where("doc_id < 30")).unionByName(unnamed).unionByName(unnamed)
    again = [r.doc_id for r in simhash.representatives(odd).collect()]
    assert again.count(None) == 2 and sorted(x for x in again if x is not None) == sorted(kept)


def test_fingerprint_links_are_complete(spark):
    r = random.Random(3)
    base = [r.getrandbits(64) for _ in range(30)]
    fps = set(base)
    for b in base:
        for _ in range(8):
            x = b
            for _ in range(r.randint(1, 5)):
                x ^= 1 << r.randrange(64)
            fps.add(x)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    want = {(min(a, b), max(a, b)) for a in signed for b in signed if a != b and ((a ^ b) & (1 << 64) - 1).bit_count() <= 4}
    got = [tuple(x) for x in simhash.fingerprint_links(spark.createDataFrame([(f,) for f in signed], "fp long")).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_ball_table_is_never_broadcast(spark):
    prints = spark.range(50_000).select(F.xxhash64("id").alias("fp"))
    links = simhash.fingerprint_links(common.materialize(prints, "test"))
    assert links.count() == 0
    plan = links._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_near_duplicates_without_ids(spark):
    docs = spark.createDataFrame([(None, "a b c d e"), (None, "a b c d e"), (4, "A b c d e"), (4, "A b c d e"), (None, "z y x w v u"), (9, None)], "doc_id long, text string")
    got = sorted(((x.doc_id, x.component_id) for x in simhash.near_duplicates(docs).collect()), key=repr)
    assert got == sorted([(None, 4), (None, 4), (4, 4), (4, 4), (None, None), (9, 9)], key=repr)


def test_connected_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 7), (200, 201), (5, 5), (200, 201), (None, 3)]
    df = spark.createDataFrame(edges, "a long, b long").repartition(5)
    got = {r.node: r.component for r in common.connected_components(df).collect()}
    assert got == {**{i: 1 for i in range(1, 41)}, 100: 1, 200: 200, 201: 200}


# 3, 8 ---------------------------------------------------------------------------------------------------------------


def odd_strings(n, seed):
    r = random.Random(seed)
    alphabet = " \t\n\r\x0b\x1c\x85\xa0  abAB'sdé中😀12.,!-–̈ßÅ‍　ſΣσİ"
    return ["".join(r.choice(alphabet) for _ in range(r.randint(0, 40))) + r.choice(["", "<|endoftext|>", " <|endoftext|>x"]) for _ in range(n)]


def test_bpe(spark):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(bpe.default_tokenizer())
    texts = corpus(3) + odd_strings(400, 1) + ["a" * k for k in range(60)]
    rows = {r.doc_id: r.ids for r in bpe.encode(documents(spark, texts)).collect()}
    said = {r.doc_id: r.text for r in bpe.decode(bpe.encode(documents(spark, texts))).collect()}
    got = {r.doc_id: r for r in bpe.digests(documents(spark, texts)).collect()}
    for i, t in enumerate(texts):
        ids = tok.encode(t or "", add_special_tokens=False).ids
        assert rows[i] == ids and got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        text = tok.decode(ids, skip_special_tokens=False)
        assert said[i] == text and got[i].decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert bpe.digests(empty(spark)).count() == 0


def test_small_automaton():
    chars = {c: i for i, c in enumerate(bpe.byte_alphabet())}
    merges = [("a", "b"), ("b", "c"), ("ab", "c"), ("a", "a"), ("aa", "aa"), ("c", "ab")]
    vocab = chars | {a + b: 256 + k for k, (a, b) in enumerate(merges)}
    auto = bpe.TokenAutomaton(vocab, merges)
    name = {i: t for t, i in vocab.items()}
    r = random.Random(1)

    def by_rank(word):
        parts = list(word)
        while True:
            best = min((merges.index(p), k) for k, p in enumerate(zip(parts, parts[1:])) if p in merges) if any(p in merges for p in zip(parts, parts[1:])) else None
            if best is None:
                return parts
            a, b = merges[best[0]]
            out, k = [], 0
            while k < len(parts):
                if k + 1 < len(parts) and (parts[k], parts[k + 1]) == (a, b):
                    out.append(a + b)
                    k += 2
                else:
                    out.append(parts[k])
                    k += 1
            parts = out

    for _ in range(500):
        w = "".join(r.choice("abc") for _ in range(r.randint(1, 12)))
        assert [name[i] for i in auto.encode_word(w.encode())] == by_rank(w)
    with pytest.raises(ValueError):
        bpe.TokenAutomaton(vocab, merges + [("a", "b")])


def test_word_pieces(spark):
    from tokenizers import models

    start, more = wordpiece.read_pieces(wordpiece.default_vocabulary())
    vocab = {"[UNK]": 0}
    for p in [*start, *("##" + p for p in more)]:
        vocab.setdefault(p, len(vocab))
    wp = models.WordPiece(vocab, unk_token="[UNK]", max_input_chars_per_word=10**9)
    texts = corpus(4) + odd_strings(300, 2)
    got = {r.doc_id: r for r in wordpiece.token_counts(documents(spark, texts)).collect()}
    for i, t in enumerate(texts):
        pieces = [wp.tokenize(w) for w in WORD.findall(t or "")]
        assert (got[i].n_words, got[i].n_tokens) == (len(pieces), sum(map(len, pieces)))
        assert got[i].n_unknown == sum(p[0].value == "[UNK]" for p in pieces)
    assert wordpiece.token_counts(empty(spark)).count() == 0


def test_word_pieces_after_the_bare_mark(spark):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=wordpiece.default_vocabulary())
    vocab = {sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))}
    mark = wordpiece.WORD_MARK
    assert mark in vocab

    def greedy(word):
        """Pieces of the whole vocabulary, the bare mark left out; None if some character has no piece."""
        rest, n = mark + word, 0
        while rest:
            k = next((k for k in range(min(len(rest), 40), 0, -1) if rest[:k] in vocab and (rest[:k].startswith(mark) == (len(rest) == len(word) + 1))), 0)
            if not k:
                return None
            n += rest[:k] != mark
            rest = rest[k:]
        return n

    r = random.Random(5)
    cjk = [p for p in vocab if len(p) == 1 and "一" <= p <= "鿿"]
    words = ["4952935900253052", "2024-01-01", "1a", "the", "7" * 5000, "中国人民", "\ue000", "1\ue000", "12the", "-5", ".net"]
    words += ["".join(r.choice(cjk) for _ in range(r.randint(1, 300))) for _ in range(50)]
    words += ["".join(r.choice("0123456789-.:,/()ab中ще") for _ in range(r.randint(1, 30))) for _ in range(300)]
    got = {x.doc_id: (x.n_tokens, x.n_unknown) for x in wordpiece.token_counts(documents(spark, words)).collect()}
    want = [greedy(w) for w in words]
    assert [got[i] for i in range(len(words))] == [(1, 1) if n is None else (n, 0) for n in want]
    assert want[:6] == [16, 10, 2, 1, 5000, 4] and want[6] is None and want[7] is None


def test_chat_budget_of_digits(spark):
    turns = [(1, k, "user" if k % 2 == 0 else "assistant", t * 600) for k, t in enumerate("1中2国")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    assert [(x.n_repeated, x.n_turns) for x in chat.format_conversations(df).orderBy("window").collect()] == [(0, 1)] * 4


# 4 ------------------------------------------------------------------------------------------------------------------

EMAIL, IP = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD, PHONE = re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def brute_spans(t):
    out = [("email", *m.span()) for m in EMAIL.finditer(t)]
    out += [("ip", *m.span()) for m in IP.finditer(t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in CARD.finditer(t):
        d = [int(c) for c in m[0] if c.isdigit()][::-1]
        if 12 <= len(d) <= 19 and sum(sum(divmod(v * (1 + k % 2), 10)) for k, v in enumerate(d)) % 10 == 0:
            out.append(("card", *m.span()))
    return out + [("phone", *m.span()) for m in PHONE.finditer(t) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]


def private_texts():
    r = random.Random(6)
    out = list(ODD)
    for k in range(1200):
        body = " ".join("".join(r.choice("abcdeghno") for _ in range(r.randint(2, 7))) for _ in range(12))
        card = [r.randint(0, 9) for _ in range(15)]
        card.append((10 - sum(sum(divmod(v * (1 + (k2 + 1) % 2), 10)) for k2, v in enumerate(card[::-1])) % 10) % 10)
        data = [f"mail jo{k}@mail{k}.example.com", f"from 10.{k % 256}.3.4", "card " + "".join(map(str, card)), f"call +1 (0{k % 9}7) 555-77{k % 90 + 10}", "".join(str(r.randint(0, 9)) for _ in range(16)), "n 300.1.2.3 at home. The"]
        out.append(body + " " + data[k % 6] + " " + body)
    return out


def test_personal_data(spark):
    texts = private_texts()
    docs = documents(spark, texts)
    model = personal_data.fit(docs)
    got = {r.doc_id: r for r in personal_data.find(docs, model).collect()}
    for i, t in enumerate(texts):
        base = sorted(brute_spans(t or ""), key=lambda x: (x[1], personal_data.KINDS.index(x[0])))
        line = ",".join(f"{k}:{s}:{e}" for k, s, e in base)
        assert got[i].base_sha256 == hashlib.sha256(line.encode()).hexdigest()
        assert tuple(got[i][f"n_{k}"] for k in personal_data.KINDS) == tuple(sum(x[0] == k for x in base) for k in personal_data.KINDS)
        assert set(line.split(",")) - {""} <= set(got[i].spans.split(","))
        if i < len(ODD):
            assert got[i].spans == line
    r = random.Random(8)
    for _ in range(4000):
        t = "".join(r.choice(r.choice(["a@.-1 ", "12.. ", "0123456789- ", "+1234567 ().-"])) for _ in range(r.randint(0, 40)))
        assert personal_data.base_spans(t) == brute_spans(t)
    call = "please call 1 (017) 555-7713 now"
    assert model.additions(call, []) == [("phone", 12, 28)]
    clean = {x.doc_id: x.text for x in personal_data.redact(docs, model).collect()}
    assert "[EMAIL]" in clean[len(ODD)] and not EMAIL.search(clean[len(ODD)]) and clean[0] is None
    assert personal_data.find(empty(spark)).count() == 0


def test_loose_personal_data():
    """Trees learn from fixed formats; loose spans planted in other texts are found with precision, look-alikes aren't."""
    r = random.Random(16)
    word = lambda: "".join(r.choice("abcdeghnorst") for _ in range(r.randint(2, 8)))

    def card():
        d = [r.randint(0, 9) for _ in range(15)]
        return "".join(map(str, d)) + str((10 - sum(sum(divmod(v * (1 + (k + 1) % 2), 10)) for k, v in enumerate(d[::-1])) % 10) % 10)

    def row(loose):
        c, ip, name = card(), ".".join(str(r.randint(1, 255)) for _ in range(4)), f"{word()}@{word()}.{word()}.com"
        phone = f"+1 ({r.randint(200, 999)}) 555-{r.randint(1000, 9999)}"
        if loose:
            c, ip, name, phone = ".".join(c[k : k + 4] for k in (0, 4, 8, 12)), ip.replace(".", "[.]"), name.replace("@", " at ").replace(".", " dot "), phone[1:]
        kind, said = r.choice([("card", c), ("ip", ip), ("email", name), ("phone", phone)])
        before = " ".join(word() for _ in range(12)) + " "
        return before + said + " " + " ".join(word() for _ in range(12)), (kind, len(before), len(before) + len(said))

    train = [(k, y, x) for k in range(400) for y, x in personal_data.training_rows(row(False)[0] + f" {word()} at {word()}. The " + " ".join(r.choice((word(), str(r.randint(1000, 9999)))) for _ in range(4)))]
    model = personal_data.model_of(np.array([x for _, _, x in train]), np.array([float(y) for _, y, _ in train]), np.array([k for k, _, _ in train]))
    assert all(t < 1 for t in model.thresholds.values())
    found = right = 0
    planted = [row(True) for _ in range(400)]
    for text, span in planted:
        got = model.additions(text, personal_data.base_spans(text))
        found += len(got)
        right += span in got
    assert right >= 0.8 * len(planted) and right >= 0.95 * found
    alike = ["we meet at noon. The end of it", "card 1234.5678.9012.3456 or 1111_2222_3333_4445", "host 300[.]400[.]1[.]2 down", "from 10.20.30.40 to 11.12.13.14"]
    assert [model.additions(t, personal_data.base_spans(t)) for t in alike] == [[]] * len(alike)


def test_boosted_trees():
    r = np.random.default_rng(1)
    x = r.normal(size=(3000, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    p = boosting.BoostedTrees().fit(x[:2000], y[:2000]).predict(x[2000:])
    assert ((p > 0.5) == y[2000:]).mean() > 0.95
    t = boosting.calibrated_threshold(p, y[2000:], 0.97)
    assert y[2000:][p >= t].mean() >= 0.97 and boosting.calibrated_threshold(p, np.zeros(1000), 0.97) == 2.0


# 5 ------------------------------------------------------------------------------------------------------------------


def test_quality_classifier(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = quality_classifier.score(docs, labels).toPandas()
    assert len(got) == docs.count() and got.score.between(0, 1).all()
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in got.doc_id]).all()
    assert (got.predicted == (got.score >= 0.3)).all()
    m = got.merge(labels.toPandas(), on="doc_id")
    m = m[m.held_out]
    assert (m.predicted == m.quality).mean() > 0.9 and (m[m.quality == 1].predicted == 1).mean() > 0.97
    x = quality_classifier.score(documents(spark, corpus(5)), labels.where("false"))
    assert [r.score for r in x.select("score").distinct().collect()] == [1.0]
    assert quality_classifier.score(empty(spark), labels).count() == 0


def test_quality_scores_beside_a_dense_fit(spark):
    q = quality_classifier
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    x = {i: np.array(q.statistics(t)) for i, t in texts.items()}
    marks = {r.doc_id: r.quality for r in labels.collect() if r.quality in (0, 1) and r.doc_id in x}
    fold = {i: zlib.crc32(str(i).encode()) % 5 for i in x}
    rng = np.random.default_rng(q.SEED)
    d = len(q.STATISTICS)
    omega, phase = rng.normal(size=(d, q.FEATURES)) * np.sqrt(2 * q.GAMMA), rng.uniform(0, 2 * np.pi, q.FEATURES)
    main, held = ([i for i in marks if (fold[i] in (1, 2, 3)) == own and fold[i]] for own in (True, False))
    xm, ym = np.array([x[i] for i in main]), np.array([marks[i] for i in main], float)
    mean, scale = xm.mean(axis=0), np.sqrt(np.maximum((xm * xm).mean(axis=0) - xm.mean(axis=0) ** 2, 1e-8)) + 1e-4

    def features(v):
        return np.hstack([np.sqrt(2 / q.FEATURES) * np.cos(np.clip((v - mean) / scale, -8, 8) @ omega + phase), np.ones((len(v), 1))])

    z = features(xm)
    w = np.linalg.solve(z.T @ z + q.RIDGE * np.eye(z.shape[1]), z.T @ ym)
    bins = np.clip((features(np.array([x[i] for i in held])) @ w + 0.5) / 2 * q.BINS, 0, q.BINS - 1).astype(int)
    n, good = np.bincount(bins, minlength=q.BINS), np.bincount(bins, [marks[i] for i in held], minlength=q.BINS)
    full = np.flatnonzero(n)
    level = q.pool_adjacent_violators((good[full] + 0.01) / (n[full] + 0.02), n[full].astype(float))
    # labels that repeat count once, clashing and null ones not at all
    odd = labels.unionByName(labels.where("doc_id % 3 = 0")).unionByName(labels.limit(5).withColumn("quality", F.lit(None).cast(labels.schema["quality"].dataType)))
    for got in q.score(docs, odd).collect():
        want = np.interp(features(x[got.doc_id][None])[0] @ w, (full + 0.5) / q.BINS * 2 - 0.5, level)
        assert got.score == pytest.approx(min(1, max(0, want)), abs=1e-6)


def test_pool_adjacent_violators():
    got = quality_classifier.pool_adjacent_violators(np.array([1.0, 3, 2, 4]), np.array([1.0, 1, 3, 1]))
    assert got.tolist() == [1, 2.25, 2.25, 4]


# 6 ------------------------------------------------------------------------------------------------------------------


def test_chat(spark):
    r = random.Random(9)
    said = ["</s>[INST] ok [/INST]", "\\\\[INST]\\</s>\\", "", None, "plain words", "<<SYS>> x <</SYS>>", '[TURN "a"] b [/TURN]', "word " * 900, "[ANSWER] <s>"]
    rows = []
    for c in [-1, *range(12), None]:
        if c is None or c % 2 == 0:
            rows.append((c, 0, "system", r.choice(said[:7])))
        rows += [(c, k, r.choice(["user", "assistant", "assistant", "tool\n", None]), r.choice(said)) for k in range(1, r.randint(2, 30))]
    rows.append(rows[-1])
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("window", F.lit(1))
    windows = chat.format_conversations(df, 300, 80)
    got = {x.conv_id: x for x in chat.read_back(windows).collect()}
    assert len(got) == len({x[0] for x in rows})
    for c, x in got.items():
        mine = sorted(((k, o or "", t or "") for a, k, o, t in rows if a == c))
        assert x.n_turns == len(mine)
        assert x.turns_sha256 == hashlib.sha256("".join(f"{o}\n{t}\n" for _, o, t in mine).encode()).hexdigest()
        loss = "".join(t for _, o, t in mine if o == "assistant")
        assert (x.loss_chars, x.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert any(w.n_repeated for w in windows.collect())
    assert chat.read_back(chat.format_conversations(df.where("false"))).count() == 0


def test_chat_blocks(spark, monkeypatch):
    """A conversation longer than a block is formatted in several, and read back whole."""
    monkeypatch.setattr(chat, "BLOCK_TURNS", 7)
    r = random.Random(4)
    rows = [(1, 0, "system", "be brief")] + [(1, k, ("user", "assistant")[k % 2], "word " * r.randint(0, 60)) for k in range(1, 60)] + [(2, 3, "assistant", None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    windows = chat.format_conversations(df, 200, 40)
    assert {w.block for w in windows.where("conv_id = 1").collect()} == set(range(9))
    assert all(w.text.startswith("<s>") and "be brief" in w.text for w in windows.where("conv_id = 1").collect())
    for x in chat.read_back(windows).collect():
        mine = [(o, t or "") for c, _, o, t in rows if c == x.conv_id]
        loss = "".join(t for o, t in mine if o == "assistant")
        assert x.n_turns == len(mine) and x.turns_sha256 == hashlib.sha256("".join(f"{o}\n{t}\n" for o, t in mine).encode()).hexdigest()
        assert (x.loss_chars, x.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_chat_windows_follow_positions_not_numbers(spark, monkeypatch):
    """The same turns give the same windows, however they are numbered, and history crosses a block's border."""
    said = [("user" if k % 2 == 0 else "assistant", f"turn {k} " + "word " * 20) for k in range(30)]

    def windows(numbers):
        df = spark.createDataFrame([(1, n, o, t) for n, (o, t) in zip(numbers, said)], "conv_id long, turn long, role string, text string").repartition(4)
        return sorted((w.block, w.window, w.text, w.n_repeated) for w in chat.format_conversations(df, 200, 80).collect())

    plain = windows(range(30))
    assert len(plain) < 10 and sum(w[3] for w in plain) > 4
    assert windows([k * 5000 for k in range(30)]) == windows([k - 90 for k in range(30)]) == windows([None, *range(1, 30)]) == plain
    monkeypatch.setattr(chat, "BLOCK_TURNS", 10)
    cut = windows(range(30))
    assert {w[0] for w in cut} == {0, 1, 2} and all(w[3] > 0 for w in cut if w[1] or w[0])  # each but the first repeats turns


def test_chat_repeated_turn_numbers(spark):
    rows = [(1, 5, "user", "b"), (1, 5, "user", "b"), (1, 5, "assistant", "a"), (1, -3, "user", "z"), (1, None, "assistant", "n"), (None, 1, None, None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {x.conv_id: x for x in chat.read_back(chat.format_conversations(df)).collect()}
    order = [("assistant", "n"), ("user", "z"), ("assistant", "a"), ("user", "b"), ("user", "b")]
    assert got[1].n_turns == 5 and got[1].turns_sha256 == hashlib.sha256("".join(f"{o}\n{t}\n" for o, t in order).encode()).hexdigest()
    assert got[1].loss_chars == 2 and got[None].n_turns == 1


# 7 ------------------------------------------------------------------------------------------------------------------


def check_packing(rows, sizes, capacity):
    bins = collections.defaultdict(list)
    for x in rows:
        bins[x.sequence_id].append((x.offset, x.length))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    assert sorted(x.length for x in rows) == sorted(sizes)
    return len(bins)


def test_packing(spark):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.default_tokenizer())
    texts = corpus(6) + odd_strings(200, 4)
    rows = packing.pack_documents(documents(spark, texts), 128).collect()
    by = collections.defaultdict(list)
    for x in rows:
        by[x.doc_id].append(x)
    sizes = []
    for i, t in enumerate(texts):
        ids = tok.encode(t or "", add_special_tokens=False).ids + [1]
        parts = sorted(by[i], key=lambda x: x.piece)
        assert [(x.piece, x.start, x.length) for x in parts] == [(k, s, min(128, len(ids) - s)) for k, s in enumerate(range(0, len(ids), 128))]
        assert [x.ids_crc32 for x in parts] == [zlib.crc32(np.array(ids[s : s + 128], "<u4").tobytes()) for s in range(0, len(ids), 128)]
        sizes += [x.length for x in parts]
    n = check_packing(rows, sizes, 128)
    assert n <= packing.lower_bound(np.array(sizes), 128) + 1
    assert packing.pack_documents(empty(spark)).count() == 0


def test_packing_exchange(spark):
    r = random.Random(2)
    sizes = [r.randint(1, 100) for _ in range(900)]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(sizes)], "id long, length long")
    n = check_packing(packing.pack(df, 100, partition_pieces=100).collect(), sizes, 100)
    # parts of a hundred pieces are far below production size: their own bounds add up to more than the whole's
    assert n <= 1.03 * packing.lower_bound(np.array(sizes), 100)


def test_lower_bound():
    def best(sizes, c):
        low = [len(sizes)]

        def go(k, bins):
            if len(bins) >= low[0]:
                return
            if k == len(sizes):
                low[0] = len(bins)
                return
            for b in {*bins}:
                if b >= sizes[k]:
                    rest = list(bins)
                    rest[rest.index(b)] -= sizes[k]
                    go(k + 1, tuple(rest))
            go(k + 1, (*bins, c - sizes[k]))

        go(0, ())
        return low[0]

    r = random.Random(4)
    for _ in range(150):
        sizes = sorted((r.randint(1, 20) for _ in range(r.randint(1, 7))), reverse=True)
        n = best(sizes, 20)
        assert packing.lower_bound(np.array(sizes), 20) <= n
        assert packing.best_fit_decreasing(np.array(sizes), 20)[0].max() + 1 >= n


# 9 ------------------------------------------------------------------------------------------------------------------


def test_embeddings(spark):
    r = np.random.default_rng(3)
    rows, centre = [], r.normal(size=(6, 16))
    for i in range(240):
        v = centre[i % 6] + r.normal(size=16) * (0.05 + 0.25 * (i % 4))
        rows.append((i, [float(np.float32(x)) for x in v * r.uniform(0.1, 9)], i % 2 if i % 11 else None))
    rows += [(240 + k, rows[7][1], rows[7][2]) for k in range(5)]
    rows += [(300, None, 1), (301, [0.0] * 16, 1), (302, [float("nan")] * 16, 1), (303, [None] * 16, 1), (304, [1.0], 1), (305, [2.0], 1), (306, [], 1), (307, [float("inf")] * 16, 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("rep", F.lit(1))

    def fine(v):
        return bool(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)

    def linked(a, b):
        if a[0] == b[0] or a[2] is None or a[2] != b[2] or not (fine(a[1]) and fine(b[1])) or len(a[1]) != len(b[1]):
            return False
        x, y = np.array(a[1]), np.array(b[1])
        return x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.93

    near = {a[0]: [b[0] for b in rows if linked(a, b)] for a in rows}
    root = components(list(near), near)
    for block in (2048, 16):
        got = {x.vec_id: x for x in embeddings.near_duplicates(df, block=block).collect()}
        assert len(got) == len(rows)
        for i in near:
            assert (got[i].n_links, got[i].component_id, got[i].kept) == (len(near[i]), root[i], root[i] == i)
    assert embeddings.near_duplicates(df.where("false")).count() == 0


def test_embeddings_of_extreme_size(spark):
    rows = [(1, [1e300, 2e300, 0.0], 1), (2, [1e-300, 2e-300, 0.0], 1), (3, [1.0, 2.0, 1e-9], 1), (4, [-1e308, 1e308, 1.0], 1), (None, [1.0, 2.0, 0.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label long")
    got = {x.vec_id: (x.n_links, x.component_id) for x in embeddings.near_duplicates(df).collect()}
    assert got == {1: (2, 1), 2: (2, 1), 3: (2, 1), 4: (0, 4), None: (0, None)}


def test_quantisation_bound():
    r = np.random.default_rng(1)
    for _ in range(200):
        u, v = (x / np.linalg.norm(x) for x in r.normal(size=(2, 64)))
        (a, s, e), (b, t, f) = embeddings.quantise(u), embeddings.quantise(v)
        bound = e * np.linalg.norm(t * b) + f * np.linalg.norm(s * a) + e * f
        assert abs(u @ v - s * t * (a.astype(int) @ b.astype(int))) <= bound


# 10 -----------------------------------------------------------------------------------------------------------------


def brute_removal(texts, span):
    data, seen = [(t or "").encode() for t in texts], collections.Counter()
    for b in data:
        for i in range(len(b) - span + 1):
            seen[b[i : i + span]] += 1
    out = []
    for b in data:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - span + 1):
            if seen[b[i : i + span]] > 1:
                gone[i : i + span] = True
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        out.append((len(b), int(gone.sum()), len(common.spans_of(gone)), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("span,seed", [(100, 16), (64, 32)])
def test_repeated_strings(spark, span, seed):
    r = random.Random(span)
    words = ["".join(r.choice("abcdeé") for _ in range(r.randint(1, 7))) for _ in range(300)]
    text = lambda n: " ".join(r.choice(words) for _ in range(n))
    shared = [text(40) for _ in range(6)]
    texts = [None, "", "x"]
    for i in range(48):
        k = i % 6
        texts.append([text(r.randint(0, 80)), text(20) + shared[k][: r.randint(80, 200)] + text(20), shared[k][r.randint(0, 50) :] + text(9), "ab" * r.randint(10, 200), "x" * r.randint(50, 300), texts[-1]][k])
    got = {x.doc_id: (x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in substrings.removal_report(documents(spark, texts), span, seed).collect()}
    assert [got[i] for i in range(len(texts))] == brute_removal(texts, span)
    if span == 64:
        clean = {x.doc_id: x.text for x in substrings.clean(documents(spark, texts), span, seed).collect()}
        assert clean[0] is None and len(clean) == len(texts)
        assert substrings.removal_report(empty(spark)).count() == 0


def test_doubled_ranks():
    r = np.random.default_rng(2)
    data = r.integers(97, 99, 4000, dtype=np.uint8)
    at = r.integers(0, 3900, 500)
    with np.errstate(over="ignore"):
        for length in (16, 17, 32, 50, 64, 100):
            for first in (substrings.seed_hashes(data, 16).__getitem__, substrings._first_ranks(data, 16, substrings._LANES[1])):
                rank = substrings.doubled(first, at, length, 16, substrings._LANES[0])
                names = collections.defaultdict(set)
                for p, k in zip(at.tolist(), rank.tolist()):
                    names[data[p : p + length].tobytes()].add(k)
                assert all(len(k) == 1 for k in names.values()) and len(names) == len(set(rank.tolist()))


def test_copies_count_once_in_the_rounds(spark):
    r = random.Random(12)
    text = lambda n: "".join(r.choice("abcdefgh ") for _ in range(n))
    one, two, short = text(700), text(300), text(60)
    texts = [one, one, one, two + one[100:350] + two, short, short, None, None, "", one[600:] + text(50), text(4000)]
    df = documents(spark, texts).unionByName(documents(spark, texts).where("doc_id in (5, 10)")).unionByName(documents(spark, [text(200)] * 2).withColumn("doc_id", F.lit(None).cast("long")))
    rows = df.collect()
    want = collections.Counter((x.doc_id, *w) for x, w in zip(rows, brute_removal([x.text for x in rows], 100)))
    got = collections.Counter((x.doc_id, x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in substrings.removal_report(df, 100, 16).collect())
    assert got == want
    assert len(substrings.clean(df, 100, 16).collect()) == len(rows)


def test_unique_text_over_segments(spark):
    r = random.Random(7)
    long = "".join(r.choice("abcdefgh ") for _ in range(5000))
    texts = [long, long[1000:1300], None, "é" * 200]
    for segment in (7, 333, 1000):
        joined = "".join(t or "" for t in texts).encode()
        offsets = np.cumsum([0, *(len((t or "").encode()) for t in texts)])
        whole, cut = (substrings.anchors(np.frombuffer(joined, np.uint8), offsets, 100, 16, k) for k in (1 << 20, segment))
        assert all((a == b).all() for a, b in zip(whole, cut)) and len(whole[0])
    for case in ([long], texts):
        got = {x.doc_id: (x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in substrings.removal_report(documents(spark, case), 100, 16, 333).collect()}
        assert [got[i] for i in range(len(case))] == brute_removal(case, 100)
    assert brute_removal([long], 100)[0][1] == 0


# pipeline -----------------------------------------------------------------------------------------------------------


def test_passage_stage_finds_fifty_words(spark):
    """Planted passages of 51 to 70 words go, documents without one stay as they are."""
    import corpus_pipeline

    r = random.Random(21)
    words = ["".join(r.choice("abcdeghinorst") for _ in range(r.randint(2, 8))) for _ in range(4000)]
    text = lambda k: " ".join(r.choice(words) for _ in range(k))
    shared = [text(r.randint(51, 70)) for _ in range(20)]
    texts = [f"{text(80)} {shared[i % 20]} {text(80)}" if i < 60 else text(200) for i in range(120)]
    got = {x.doc_id: x.text for x in corpus_pipeline.cut_repeated_passages(spark, documents(spark, texts), SF).collect()}
    caught = sum(len(got[i].split()) < len(texts[i].split()) - 40 for i in range(60))
    assert caught >= 0.9 * 60 and sum(got[i] == texts[i] for i in range(60, 120)) >= 0.98 * 60


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = common.materialize(stage(spark, before, SF), "test")
        assert after.columns == docs.columns
        a, b = {r.doc_id: r.text for r in before.collect()}, {r.doc_id: r.text for r in after.collect()}
        assert set(b) <= set(a)
        if name == "SimHash near-dedup":
            prints = {i: brute_print(t) for i, t in a.items()}
            near = {i: [j for j in a if j != i and (prints[i] ^ prints[j]).bit_count() <= corpus_pipeline.MAX_BITS] for i in a}
            assert set(b) == set(components(list(a), near).values())
        if name == "suffix-array dedup":
            ids = sorted(a)
            assert [len(b[i].encode()) for i in ids] == [n - k for n, k, _, _ in brute_removal([a[i] for i in ids], corpus_pipeline.PASSAGE_SPAN)] and set(a) == set(b)
        if name == "PII":
            assert all(not brute_spans(t) for t in b.values()) and all(a[i] == b[i] for i in a if not brute_spans(a[i]))
        before = after
    rows = corpus_pipeline.run(spark, SF).collect()
    assert {x.doc_id for x in rows} == set(b)
    check_packing(rows, [x.length for x in rows], 4096)


def test_pipeline_of_odd_rows_and_of_none(spark, tmp_path):
    """Rows without id stay, null texts are empty, clashing extra columns pass through, an empty table gives an empty result."""
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumns({c: F.lit("x") for c in ("fp", "label", "score", "d", "th", "n", "piece")})
    odd = docs.where("doc_id < 40").unionByName(docs.where("doc_id = 3")).unionByName(docs.where("doc_id in (5, 7)").withColumn("doc_id", F.lit(None).cast("long")))
    odd = odd.unionByName(docs.where("doc_id = 41").withColumn("text", F.lit(None).cast("string")))
    before = odd
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = common.materialize(stage(spark, before, SF), "odd")
        assert after.columns == odd.columns
        if name == "SimHash near-dedup":
            assert after.where("doc_id is null").count() == before.where("doc_id is null").count() and after.where("doc_id = 3").count() <= 1
        before = after
    packed = corpus_pipeline.STAGES[-1][1](spark, before, SF)
    assert packed.where("piece = 0").count() == before.count()
    (tmp_path / "sf").mkdir()
    spark.read.parquet(f"{SF}/documents.parquet").limit(0).write.parquet(f"file://{tmp_path}/sf/documents.parquet")
    spark.read.parquet(f"{SF}/labels.parquet").write.parquet(f"file://{tmp_path}/sf/labels.parquet")
    assert corpus_pipeline.run(spark, f"file://{tmp_path}/sf").count() == 0
