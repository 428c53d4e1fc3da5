"""Small cases of the operators, each against a plain version."""

import base64
import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
import tiktoken
import public_tokenizers

from counterpoise.llm import (bpe, fingerprints, labelled, licenses, lines, mixing, neardup_vectors,
                              pseudo_likelihood, quality, shingles, toxicity)
from counterpoise.llm.components import connected

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, cid string"


def docs_of(spark, texts, source="a"):
    return spark.createDataFrame([(i, t, "en", source, len(t or ""), "x", "y") for i, t in enumerate(texts)], SCHEMA)


@pytest.fixture(scope="module")
def reference_coder():
    with open(PATH, "rb") as lines_:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines_)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_is_the_librarys(spark, reference_coder):
    draw = random.Random(5)
    texts = ["", None, "a" * 3000, "the the  the", "é中\U0001f600" * 7, "<|endoftext|>", " \n\t x"] + [
        "".join(draw.choice("abeint hrs.\né'0") for _ in range(draw.randrange(1, 60))) for _ in range(200)]
    rows = bpe.coded(docs_of(spark, texts), ["doc_id"], PATH, public_tokenizers.PATTERN).collect()
    assert len(rows) == len(texts)
    for row in rows:
        text = texts[row["doc_id"]] or ""
        assert row["ids"] == reference_coder.encode_ordinary(text)
        assert bytes(row["decoded"]).decode() == text
    columns = docs_of(spark, texts[:3]).select(bpe.encode("text", PATH, public_tokenizers.PATTERN).alias("i"))
    assert [bytes(r[0]) for r in columns.select(bpe.decode("i", PATH)).collect()] == [b"", b"", b"a" * 3000]


def test_components_of_chain_star_and_loop(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, 100 + i) for i in range(1, 40)] + [(7000, 7000), (None, 3)]
    found = {r["node"]: r["component"] for r in connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {**dict.fromkeys(range(51), 0), **dict.fromkeys(range(100, 140), 100), 7000: 7000}
    assert connected(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_by_contraction(spark, monkeypatch):
    monkeypatch.setattr("counterpoise.llm.components.LAST", 0)
    edges = [(i, i + 1) for i in range(60)] + [(200, 200 + i) for i in range(1, 30)]
    found = {r["node"]: r["component"] for r in connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {**dict.fromkeys(range(61), 0), **dict.fromkeys(range(200, 230), 200)}


def _texts(seed, count):
    draw = random.Random(seed)
    word = lambda: "".join(draw.choice("abcdefgh") for _ in range(5))
    out = []
    for _ in range(count):
        base = [word() for _ in range(draw.randrange(3, 80))]
        out.append(" ".join(base))
        for _ in range(draw.randrange(0, 4)):
            near = list(base)
            near[draw.randrange(len(near))] = word()
            out.append(" ".join(near))
    return out


def test_jaccard_join_is_brute_force(spark):
    texts = _texts(1, 60) + ["", None, "one two", "ONE  two"]
    sets = [frozenset(tuple(w[i:i + min(5, len(w))]) for i in range(len(w) - min(5, len(w)) + 1)) if w else frozenset()
            for w in ((t or "").lower().split() for t in texts)]
    same = lambda a, b: a == b or (len(a | b) and len(a & b) >= 0.8 * len(a | b) - 1e-9)
    links = {i: [j for j in range(len(sets)) if j != i and same(sets[i], sets[j])] for i in range(len(sets))}
    group = {}
    for i in range(len(sets)):
        if i not in group:
            queue = [i]
            while queue:
                x = queue.pop()
                if x not in group:
                    group[x] = i
                    queue += links[x]
    docs = docs_of(spark, texts)
    for row in shingles.report(docs).collect():
        assert (row["n_links"], row["class_id"]) == (len(links[row["doc_id"]]), group[row["doc_id"]])
    kept = shingles.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(group.values()))
    assert shingles.one_of_each(docs.union(docs)).count() == len(set(group.values()))
    assert shingles.report(docs.limit(0)).count() == 0


def test_vectors_are_brute_force(spark):
    draw = np.random.default_rng(2)
    base = draw.normal(size=(40, 16))
    vectors = np.vstack([base, base + draw.normal(0, 0.08, base.shape), base[:5], base[:5] * 3]).astype(np.float32)
    rows = [(i, [float(x) for x in v], 0) for i, v in enumerate(vectors)]
    rows += [(1000, None, 0), (1001, [0.0] * 16, 0), (1002, [float("nan")] + [1.0] * 15, 0), (1003, [None] + [1.0] * 15, 0), (1004, [], 0)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    unit = vectors.astype(float) / np.linalg.norm(vectors.astype(float), axis=1, keepdims=True)
    hit = unit @ unit.T >= 0.95
    np.fill_diagonal(hit, False)
    for block in (2048, 16):
        found = {r["vec_id"]: r for r in neardup_vectors.report(table, block=block).collect()}
        assert len(found) == len(rows)
        assert [found[i]["n_links"] for i in range(len(vectors))] == hit.sum(axis=1).tolist()
        assert all(found[i]["n_links"] == 0 and found[i]["kept"] for i in range(1000, 1005))
        assert found[45]["component_id"] <= 45
    assert neardup_vectors.report(table.limit(0)).count() == 0


def test_error_bound_holds():
    draw = np.random.default_rng(3)
    unit, whole, scale, cut = neardup_vectors.rounded(draw.normal(size=(300, 24)))
    near = (whole.astype(float) @ whole.T.astype(float)) * np.outer(scale, scale)
    assert (np.abs(near - unit @ unit.T) <= cut[:, None] + (1 + cut[:, None]) * cut[None, :] + 1e-9).all()


def test_mixing_targets_and_limits(spark):
    texts = [" ".join(["w"] * (i % 30)) for i in range(300)] + [None, "   "]
    docs = docs_of(spark, texts).unionByName(docs_of(spark, ["a b c"] * 3, "b")).unionByName(docs_of(spark, texts + ["z z"], None))
    rows = mixing.report(docs).collect()
    assert len(rows) == docs.count()
    by = {}
    for r in rows:
        by.setdefault(r["source_size"], [r["target"], 0])[1] += r["taken"]
        assert 0 <= r["taken"] <= 2 * r["size"]
    total = sum(r["size"] for r in rows)
    assert abs(sum(r["target"] for r in {r["source_size"]: r for r in rows}.values()) - 1.5 * total) < total
    for target, taken in by.values():
        assert abs(target - taken) <= 2 * 30
    assert mixing.report(docs).exceptAll(mixing.report(docs.repartition(3))).count() == 0
    assert mixing.report(docs.limit(0)).count() == 0
    assert "copies" in mixing.mixed(docs).columns


def test_lines_keep_one_of_each_group(spark):
    long = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon"
    texts = [f"{long}\nunique one\n\n---", f"unique two\n{long.upper()}!", f"{long}s", None, "", f"{long}\n{long}"]
    docs = docs_of(spark, texts)
    out = {r["doc_id"]: r for r in lines.deduplicated(docs).collect()}
    assert out[0]["text"] == texts[0] and out[1]["text"] == "unique two"
    assert out[3]["text"] is None and out[4]["text"] == "" and out[5]["text"] == ""
    assert lines.report(docs.limit(0)).count() == 0


def test_lines_with_one_edit_are_found(spark):
    draw = random.Random(9)
    word = lambda: "".join(draw.choice("abcdefghijklmnopqrstuvw") for _ in range(draw.randrange(3, 9)))
    pairs = []
    for count in [*range(8, 41)] * 8:
        line = [word() for _ in range(count)]
        other = list(line)
        at = draw.randrange(count)
        other[at] = word() if len(pairs) % 2 else other[at][:-1] + "z"
        pairs.append((" ".join(line), " ".join(other)))
    pairs += [(f"{a} {b}", f"{a}z {b}") for a, b in ((word() * 2, word() * 2) for _ in range(40))]
    pairs = [p for p in pairs if lines.similar(*p)]
    rows = {r["doc_id"]: r for r in lines.report(docs_of(spark, [x for p in pairs for x in p])).collect()}
    assert sum(rows[2 * i]["n_removed"] for i in range(len(pairs))) == 0
    assert sum(rows[2 * i + 1]["n_removed"] for i in range(len(pairs))) >= 0.98 * len(pairs)


def test_edit_distance_is_the_tables():
    def plain(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    draw = random.Random(4)
    for _ in range(300):
        a, b = ("".join(draw.choice("abc") for _ in range(draw.randrange(0, 90))) for _ in range(2))
        assert lines.edit_distance(a, b) == plain(a, b)


def test_fingerprints(spark):
    texts = ["One. Two! Three?\nFour five.\n" * 5, "", None, "Other text here. More of it.\nEnd", "x" * 1000]
    rows = {r["doc_id"]: r for r in fingerprints.report(docs_of(spark, texts)).collect()}
    order = sorted(rows, reverse=True)
    for at, i in enumerate(order):
        text, nxt = texts[i] or "", texts[order[(at + 1) % len(order)]] or ""
        cut = len(text) // 3
        edited = text[:len(text) - cut] + nxt[:cut]
        assert rows[i]["n_chars"] == len(text) and rows[i]["edited_fingerprint"] == fingerprints.fingerprint(edited)
    assert rows[1]["fingerprint"] == rows[2]["fingerprint"]
    a, b = "First. Second. Third.", "First. Changed. Third."
    assert fingerprints.edits(fingerprints.fingerprint(a), fingerprints.fingerprint(b)) == [(7, 15)]
    assert fingerprints.likeness(fingerprints.fingerprint(a), fingerprints.fingerprint(a)) == 1.0
    assert fingerprints.report(docs_of(spark, ["only"])).count() == 1


def plain_likeness(a, b):
    """Heaviest common subsequence of all leaves, over both lengths."""
    x, y = ([(d, int(n)) for d, n in re.findall(r"([0-9a-f]+)[.](\d+)", f.partition("=")[2])] for f in (a, b))
    best = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
    for i, leaf in enumerate(x):
        for j, other in enumerate(y):
            best[i + 1][j + 1] = max(best[i][j + 1], best[i + 1][j], best[i][j] + leaf[1] * (leaf == other))
    total = sum(n for _, n in x + y)
    return 2 * best[-1][-1] / total if total else 1.0


def test_fingerprints_see_moves():
    a = "Alpha here.\nBeta there.\nGamma too.\n"
    b = "Gamma too.\nAlpha here.\nBeta there.\n"
    x, y = fingerprints.fingerprint(a), fingerprints.fingerprint(b)
    assert plain_likeness(x, y) < 1 and fingerprints.likeness(x, y) == pytest.approx(plain_likeness(x, y))
    assert fingerprints.edits(x, y) == [(24, 35)] and fingerprints.moves(x, y) == [(24, 0, 11)]
    draw = random.Random(3)
    lines = [f"Line {i} of the text. And more of it {i * i}.\n" for i in range(60)]
    for _ in range(40):
        other = list(lines)
        low, high = sorted(draw.sample(range(60), 2))
        cut, at = other[low:high], draw.randrange(61)
        del other[low:high]
        if draw.random() < 0.6:
            other[at:at] = cut
        x, y = fingerprints.fingerprint("".join(lines)), fingerprints.fingerprint("".join(other))
        told, best = fingerprints.likeness(x, y), plain_likeness(x, y)
        assert best - 0.25 <= told <= best + 1e-9 and (told < 1 or x == y)
        assert fingerprints.likeness(y, x) == pytest.approx(told, abs=0.05)
        seen = "".join(lines)
        assert all(seen[i:i + n] == "".join(other)[j:j + n] for i, j, n in fingerprints.moves(x, y))


@pytest.mark.parametrize("kind", ["long", "string"])
def test_fingerprints_by_brute_force(spark, monkeypatch, kind):
    monkeypatch.setattr(fingerprints, "RANGE_BYTES", 64)
    draw = random.Random(8)
    some = ["One. Two! Three?\nFour five.\n" * 3, "", "Other text here. More of it.\nEnd", "x" * 300, "é中\U0001f600 a." * 9]
    rows = [(i, draw.choice(some) + f" {i}.") for i in range(40)] + [(None, None), (None, None), (7, ""), (50, None)]
    rows += [(60, f"Version {i % 9} of it. Same.") for i in range(60)] + [(None, f"Nameless {i}.") for i in range(30)]
    rows = [(f"d{i:03d}" if kind == "string" and i is not None else i, text) for i, text in rows]
    docs = spark.createDataFrame(rows, f"doc_id {kind}, text string").repartition(3)
    hashes = {r["t"]: r["h"] for r in docs.select(F.coalesce("text", F.lit("")).alias("t")).distinct().select(
        "t", F.xxhash64("t").alias("h")).collect()}
    order = sorted(((i, t or "") for i, t in rows), key=lambda r: hashes[r[1]], reverse=True)
    order = (sorted((r for r in order if r[0] is not None), key=lambda r: r[0], reverse=True)
             + [r for r in order if r[0] is None])
    expected = Counter()
    for (i, text), (_, following) in zip(order, order[1:] + order[:1]):
        cut = len(text) // 3
        edited = text[:len(text) - cut] + following[:cut]
        own, other, after = map(fingerprints.fingerprint, (text, edited, following))
        expected[i, len(text), hashlib.sha256(edited.encode()).hexdigest(), own, other,
                 round(plain_likeness(own, other), 9), round(plain_likeness(own, after), 9)] += 1
    found = Counter((r["doc_id"], r["n_chars"], r["edited_sha256"], r["fingerprint"], r["edited_fingerprint"],
                     round(r["near_edited"], 9), round(r["near_next"], 9)) for r in fingerprints.report(docs).collect())
    assert found == expected


def test_roots_differ_where_short_digests_meet(monkeypatch):
    monkeypatch.setattr(fingerprints, "DIGEST", 1)
    texts = [f"Text {i}.\nEnd." for i in range(1000)]
    roots = {fingerprints.fingerprint(text).partition("=")[0] for text in texts}
    assert len(roots) == len(texts) and {len(root) for root in roots} == {32}


def test_licenses(spark):
    texts = ["Code.\nReleased under the MIT License.\nBye.", "No mitigating license here", None, "",
             "Licensed under the Apache License,\nVersion 2.0. Then (c) Licensed under CC BY-NC 4.0."]
    rows = {r["doc_id"]: r for r in licenses.report(docs_of(spark, texts)).collect()}
    assert [rows[i]["licenses"] for i in range(5)] == ["MIT", "", "", "", "Apache-2.0"]
    full = docs_of(spark, [licenses.SENTENCES[7][1] + ": x. " + licenses.SENTENCES[8][1] + "."])
    assert licenses.scan(full).first()["licenses"] in (["MIT"], [])


def test_licenses_every_entry_and_rule_fires(spark):
    by_name = {name: text for name, text in reversed(licenses.SENTENCES)}
    entries = [f"Some code\n// {text}\nmore code" for _, text in licenses.SENTENCES]
    found = {r["doc_id"]: r["sentence_ids"] for r in licenses.scan(docs_of(spark, entries)).collect()}
    assert [found[i] for i in range(len(entries))] == [[name] for name, _ in licenses.SENTENCES]
    own = [". ".join(by_name[name] for name in sequence) + "." for _, sequence in licenses.RULES]
    told = {r["doc_id"]: r["licenses"] for r in licenses.scan(docs_of(spark, own)).collect()}
    assert [told[i] for i in range(len(own))] == [[name] for name, _ in licenses.RULES]
    full = docs_of(spark, [by_name["mit.grant"] + ": x. " + by_name["mit.keep"] + ".",
                           "SPDX-License-Identifier: MIT\nSPDX-License-Identifier: MPL-2.0"])
    assert [r["licenses"] for r in licenses.scan(full).orderBy("doc_id").collect()] == [["MIT"], ["MIT", "MPL-2.0"]]


def test_licenses_of_lines_and_wrapped_text_together(spark):
    apache = ("Licensed under the Apache License,\nVersion 2.0 (the \"License\"); you may not\nuse this file except in "
              "compliance\n with the License.")
    texts = ["Notes on the parts\nReleased under the MIT License.\nmore notes\n\n" + apache,
             "Notes on the parts\nReleased under the MIT License\nmore notes\n" + apache,
             apache.replace("\n", "\r\n") + "\r\nSPDX-License-Identifier: MIT\r\n",
             "/*\n * " + apache.replace("\n", "\n * ") + "\n *\n * Licensed under CC BY 4.0\n */",
             "Released under\n\nthe MIT License", "x Released under the MIT License"]
    seen = {r["doc_id"]: r for r in licenses.scan(docs_of(spark, texts)).collect()}
    ids = ["apache2.notice", "apache2.may"]
    assert [seen[i]["sentence_ids"] for i in range(6)] == [
        ["mit.notice", *ids], ["mit.notice", *ids], [*ids, "mit.notice"], [*ids, "ccby4.notice"], ["mit.title"], []]
    assert [sorted(seen[i]["licenses"]) for i in range(3)] == [["Apache-2.0", "MIT"]] * 3


def test_classifiers_learn_and_score_everything(spark):
    draw = random.Random(6)
    word = lambda: "".join(draw.choice("aeionrst") for _ in range(6))
    texts, label = [], []
    for i in range(160):
        words = [word() for _ in range(40)]
        label.append(i % 2)
        if i % 2:
            words[draw.randrange(40)] = draw.choice(["zugbuk", "zug-buk", "zugxbuk", "zugbuk"])
        texts.append(" ".join(words) + ".")
    model = toxicity.fit(texts, np.array(label), 0.5)
    reader = toxicity.Reader(toxicity.Nearness(model.landmarks))
    told = model.scores(reader, texts + ["", None, word() + " z.u.g.b.u.k here"])
    assert ((told[:160] >= 0.3) == np.array(label)).mean() > 0.95
    assert told[160] == told[161] < 0.3
    spelled = toxicity.Nearness(["^zugbuk"]).of(["^zugbuk", "^z.u.g.b.u.k", "^zugbk", "^rainer"])[:, 0]
    assert spelled[0] == pytest.approx(1) and spelled[1] > 0.1 and spelled[2] > 0.3 and spelled[3] == 0
    shouted = [t.upper() + "!!" if y else t for t, y in zip(texts, label)]
    net = quality.fit(shouted, np.array(label), 0.5, epochs=10)
    scores = net.scores(shouted + ["", None])
    assert ((scores[:160] >= 0.5) == np.array(label)).mean() > 0.9 and scores[160] == scores[161]
    assert toxicity.fit([], np.zeros(0), 0.1).scores(toxicity.Reader(toxicity.Nearness([])), ["a"])[0] == pytest.approx(0.1)


def test_convolution_gradient():
    net = quality.Network(4)
    texts, label, weight = ["some text", " ".join(f"OTHER{i * 37 % 101}!" for i in range(120))], np.array([0, 1]), np.array([1.0, 1.0])

    def loss():
        p = 1 / (1 + np.exp(-net.margins(texts)))
        return -(np.log(p[1]) + np.log(1 - p[0])) / 2

    grads = net.gradients(texts, label, weight)
    for w, g in zip(net.weights(), grads):
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        old, step = w[at], 2e-3
        w[at] = old + step
        high = loss()
        w[at] = old - step
        low = loss()
        w[at] = old
        assert (high - low) / (2 * step) == pytest.approx(g[at], rel=0.15, abs=1e-4)


def test_pseudo_likelihood_learns(spark):
    docs = docs_of(spark, ["red green blue red green blue " * 40] * 20 + ["", None])
    counts = pseudo_likelihood.counted(docs)
    words = pseudo_likelihood.vocabulary(counts)
    assert len(words) == 3
    before = pseudo_likelihood.unpacked(pseudo_likelihood.packed(pseudo_likelihood.fresh()))
    after = pseudo_likelihood.trained(docs.repartition(2), words, rounds=3)
    score = lambda w: docs.select("doc_id", pseudo_likelihood.score_of(w, words).alias("s")).collect()
    assert score(after)[0]["s"]["total"] > score(before)[0]["s"]["total"]
    rows = {r["doc_id"]: r for r in pseudo_likelihood.report(docs).collect()}
    assert rows[20]["n_words"] == rows[21]["n_words"] == 0 and rows[20]["mean_log_likelihood"] is None


def test_pseudo_likelihood_of_every_word(spark, monkeypatch):
    """Sums in plain loops over words, whatever their frequency; letter junk comes last."""
    pl = pseudo_likelihood
    draw = random.Random(4)
    lexicon = ["".join(draw.choice("abcdefgh") for _ in range(5)) for _ in range(900)]
    texts = [" ".join(lexicon[min(int(draw.expovariate(1 / 150)), 899)] for _ in range(80)) for _ in range(300)]
    junk = ["".join(draw.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(400)) for _ in range(5)]
    docs = docs_of(spark, texts + junk + [None, "", texts[0]])
    counts = pl.counted(docs)
    words = pl.vocabulary(counts)
    weights = pl.trained(docs, words)
    found = {r["doc_id"]: r for r in pl.scored(docs, weights, words, counts).collect()}

    hashes = lambda text: pl.word_hashes(pl._bytes([text]))[0].astype(np.int64).tolist()      # noqa: E731
    everywhere = Counter(h for t in texts + junk + [texts[0]] for h in hashes(t))
    rank = {h: i for i, h in enumerate(words.astype(np.int64).tolist())}
    others = sum(n for h, n in everywhere.items() if h not in rank)
    assert len(rank) == pl.WORDS - 2 < len(everywhere)
    for i in (0, 7, 301):
        text = (texts + junk)[i]
        total = 0.0
        codes = [pl.WORDS - 2] * pl.REACH + [rank.get(h, pl.WORDS - 1) for h in hashes(text)] + [pl.WORDS - 2] * pl.REACH
        for j, h in enumerate(hashes(text)):
            total += float(pl.log_chances(weights, np.array(codes), np.array([j + pl.REACH]))[0])
            if h not in rank:
                total += np.log(everywhere[h] / others)
        assert found[i]["total"] == pytest.approx(total, rel=1e-4) and found[i]["n"] == len(hashes(text))
    means = {i: r["total"] / r["n"] for i, r in found.items() if r["n"]}
    assert max(means[i] for i in range(300, 305)) < np.quantile([means[i] for i in range(300)], 0.05)
    assert found[305]["total"] == found[306]["total"] == 0 and found[307]["total"] == pytest.approx(found[0]["total"], rel=1e-4)


def test_sample_is_bounded_and_held_out(spark):
    docs = docs_of(spark, [f"text {i}" for i in range(100)])
    labels = spark.createDataFrame([(i, i % 2, None) for i in range(100)] + [(None, 1, 1), (3, None, 0)], "doc_id long, toxic int, quality int")
    frame, share = labelled.training_sample(docs, labels, "toxic", labelled.remainder("doc_id", 4) != 2, per_label=10)
    assert frame["label"].value_counts().to_dict() == {0: 10, 1: 10} and 0.3 < share < 0.7


def test_strangers_meet_a_large_group(spark):
    """Every open pair of a bucket meets in one tile, and a large group is not copied against itself."""
    rows = [(1, i, 7 if i < 90 else 100 + i) for i in range(100)] + [(2, i, i) for i in range(30)]
    sizes = {1: (100, 7, 90), 2: (30, 0, 1)}
    table = spark.createDataFrame([(key, *sizes[key], cid, group) for key, cid, group in rows],
                                  "key long, size long, main long, main_size long, cid long, group long")
    tiles = {}
    out = shingles.dealt(table, 8).collect()
    for r in out:
        tiles.setdefault((r["key"], r["tile_i"], r["tile_j"]), []).append(r)
    met = {}
    for (key, _, j), part in tiles.items():
        for a in part:
            for b in part:
                if a["cid"] < b["cid"] and (j >= 0 or a["inside"] != b["inside"]):
                    met[key, a["cid"], b["cid"]] = met.get((key, a["cid"], b["cid"]), 0) + 1
    group = {(key, cid): g for key, cid, g in rows}
    for key, top in ((1, 100), (2, 30)):
        for a in range(top):
            for b in range(a + 1, top):
                if group[key, a] != group[key, b]:
                    assert met.get((key, a, b), 0) >= 1
    assert sum(1 for r in out if r["key"] == 1 and r["inside"]) == 90


def test_crowded_buckets_are_split_without_copies(spark):
    """A set has one row for each bucket that is split, and near sets still meet in most runs."""
    draw = np.random.default_rng(3)
    passage = draw.integers(1, 2 ** 63, 60, dtype=np.uint64)
    sets = [np.sort(np.concatenate([passage, draw.integers(1, 2 ** 63, 140, dtype=np.uint64)])) for _ in range(300)]
    sets += [np.sort(np.concatenate([s[:-10], draw.integers(1, 2 ** 63, 10, dtype=np.uint64)])) for s in sets[:50]]
    runs, levels = 32, 3
    told = shingles.describe_sets(sets, runs, levels)
    assert all(len(x) == runs for level in (1, 2) for x in told[f"l{level}"])
    equal = np.mean(np.stack(told["l1"].tolist()[:50]) == np.stack(told["l1"].tolist()[300:]))
    jaccard = np.mean([len(np.intersect1d(a, b)) / len(np.union1d(a, b)) for a, b in zip(sets[:50], sets[300:])])
    assert abs(equal - jaccard) < 0.04
    rows = [(i, [int(x) for x in told["l0"][i]], *[[int(x) for x in told[f"l{level}"][i]] for level in (1, 2)])
            for i in range(len(sets))]
    picked = spark.createDataFrame(rows, "cid long, l0 array<long>, l1 array<int>, l2 array<int>")
    out = shingles.candidates(picked, None, list(range(runs)), levels, small=10).collect()
    assert len(out) <= sum(len(x) for x in told["l0"])
    met = {}
    for r in out:
        met.setdefault(r["key"], set()).add(r["cid"])
    assert all(any({i, 300 + i} <= x for x in met.values()) for i in range(50))


def test_convolution_is_the_plain_sum():
    """Scores by loops over every text, chunk, position and byte."""
    net = quality.Network(7)
    net.curve = (0.7, -0.2)
    for text in ["", None, "short", "Ärger – und mehr\n" * 9, "x" * (quality.CHUNK + 5), "abc def " * quality.CHUNK]:
        data = (text or "").encode()
        step = quality.CHUNK - quality.OVERLAP
        chunks, low = [], 0
        while not chunks or low + quality.OVERLAP < len(data):
            chunks.append((data[low:low + quality.CHUNK]).ljust(quality.CHUNK, b"\0"))
            low += step
        pooled = []
        for chunk in chunks:
            top = np.full(quality.FILTERS, -np.inf)
            for at in range(0, quality.CHUNK - quality.WIDTH + 1, quality.STRIDE):
                inputs = np.concatenate([net.vectors[b] for b in chunk[at:at + quality.WIDTH]])
                top = np.maximum(top, inputs @ net.filters + net.bias)
            pooled.append(np.maximum(top, 0))
        told = np.concatenate([np.mean(pooled, axis=0), np.max(pooled, axis=0)])
        want = 1 / (1 + np.exp(-(0.7 * (told @ net.out + net.offset[0]) - 0.2)))
        assert net.scores([text])[0] == pytest.approx(float(want), abs=1e-5)


def test_line_groups_are_brute_force(spark):
    """Removed lines by comparing all pairs of lines of some documents."""
    draw = random.Random(21)
    word = lambda: "".join(draw.choice("abcdefghijklmnopqrst") for _ in range(draw.randrange(4, 9)))
    bases = [[word() for _ in range(draw.randrange(12, 30))] for _ in range(12)]
    texts = []
    for _ in range(25):
        rows = []
        for _ in range(draw.randrange(0, 5)):
            line = list(draw.choice(bases))
            kind = draw.randrange(4)
            if kind == 0:
                line[draw.randrange(len(line))] = word()
            elif kind == 1:
                line = [w.upper() for w in line]
            elif kind == 2:
                line = [word() for _ in line]
            rows.append(" ".join(line) + draw.choice(["", "!", "  "]))
        texts.append("\n".join(rows))
    docs = docs_of(spark, texts)
    spots = [(i, n, b" ".join(line.split()).decode()) for i, text in enumerate(texts)
             for n, line in enumerate(lines.normal_lines(text)) if line.split()]
    group = list(range(len(spots)))
    for a in range(len(spots)):
        for b in range(a + 1, len(spots)):
            longest = max(len(spots[a][2]), len(spots[b][2]))
            if group[a] != group[b] and lines.edit_distance(spots[a][2], spots[b][2]) <= 0.2 * longest + 1e-9:
                low, high = sorted((group[a], group[b]))
                group = [low if g == high else g for g in group]
    gone = {i: [] for i in range(len(texts))}
    best = {}
    for place in sorted(range(len(spots)), key=lambda p: spots[p][:2]):
        best.setdefault(group[place], place)
        if best[group[place]] != place:
            gone[spots[place][0]].append(spots[place][1])
    assert any(gone.values())
    assert {r["doc_id"]: r["removed"] or [] for r in lines.report(docs).collect()} == gone


def test_columns_with_names_of_working_columns_pass_through(spark):
    long = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau"
    extra = {name: F.concat(F.lit(name), F.col("doc_id").cast("string")) for name in
             ("_h", "_stays", "_bucket", "_hot", "_k0", "kept_h", "Gone", "th", "line", "cid", "size")}
    docs = docs_of(spark, [f"{long}\nown {i}" if i < 4 else long for i in range(6)] + [None]).withColumns(extra)
    for out in (lines.deduplicated(docs), shingles.one_of_each(docs)):
        names = {c if c != "Gone" or "gone" not in out.columns else "Gone_input" for c in extra}
        assert names <= set(out.columns) and out.count()
        for r in out.collect():
            assert all(r[c] == c.removesuffix("_input") + str(r["doc_id"]) for c in names)
    assert shingles.one_of_each(docs).columns == docs.columns


def test_fingerprints_of_edited_texts_hash_few_lines_again():
    """Lines that an edited text shares with its source are told from memory, and long ones the same without it."""
    from counterpoise.llm import fingerprints as fp
    lines = [f"line {i} says something. And more of it!\n" for i in range(60)]
    edited = "".join(lines[:40]) + "new end"
    before = fp.fingerprint("".join(lines))
    known = fp._remembered.cache_info()
    after = fp.fingerprint(edited)
    now = fp._remembered.cache_info()
    assert now.hits - known.hits == 40 and now.misses - known.misses == 1
    assert fp.likeness(before, after) == fp.likeness(after, before) > 0.7
    for line in lines + ["x" * 5000 + ". Ä\n", "\ud800 a.b\n"]:
        assert fp.fingerprint(line).partition(":")[2] == fp._paragraph(line)[1]


def test_pieces_of_short_and_long_texts(monkeypatch):
    """Texts up to a chunk are cut at once, longer ones in chunks; both give the same ids."""
    import public_tokenizers
    import regex

    from counterpoise.llm import bpe
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    pieces, compiled = bpe._remembered(path), regex.compile(public_tokenizers.PATTERN)
    text = "It's a test,  of 123 words\n\nand Ünïcode 中文. " * 50
    whole = bpe.encode_text(text, pieces, compiled)
    asked = []

    class Cut:
        groups = 0

        def findall(self, value):
            asked.append(len(value))
            return compiled.findall(value)

        def finditer(self, value):
            return compiled.finditer(value)

    assert bpe.encode_text(text, pieces, Cut()).tolist() == whole.tolist() and asked == [len(text)]
    monkeypatch.setattr(bpe, "_CHUNK", 100)
    assert bpe.encode_text(text, pieces, Cut()).tolist() == whole.tolist() and asked == [len(text)]
    assert bpe.encode_text(None, pieces, Cut()).tolist() == bpe.encode_text("", pieces, Cut()).tolist() == []


def test_pieces_by_backtracking_are_those_of_merging():
    from counterpoise.llm import bpe
    ranks = {bytes([b]): b for b in range(256)}
    ranks |= {token: 256 + i for i, token in enumerate([b"ab", b"bc", b"cd", b"abc", b"cde", b"de", b"abcd"])}
    vocabulary, rng = bpe.Vocabulary(ranks), np.random.default_rng(3)

    def merged(piece):
        row = [bytes([b]) for b in piece]
        while len(row) > 1 and (best := min((ranks.get(a + b, 1 << 30), i) for i, (a, b) in enumerate(zip(row, row[1:]))))[0] < 1 << 30:
            row[best[1]:best[1] + 2] = [row[best[1]] + row[best[1] + 1]]
        return [ranks[x] for x in row]
    for _ in range(500):
        piece = bytes(rng.choice(list(b"abcde"), rng.integers(1, 12)).tolist())
        assert vocabulary.encode(piece) == ([ranks[piece]] if piece in ranks else merged(piece))


def test_ascii_texts_are_cut_as_by_the_whole_pattern():
    import re

    import public_tokenizers
    import regex
    from counterpoise.llm import bpe
    whole = regex.compile(public_tokenizers.PATTERN)
    quick, rng = bpe.ascii_pattern(whole), np.random.default_rng(4)
    assert isinstance(quick, re.Pattern)
    every = [chr(i) for i in range(128)]
    texts = ["".join(rng.choice(every, 200)) for _ in range(300)]
    texts += ["".join(rng.choice(list(" \t\n\x1c\x1fab1's.re"), 60)) for _ in range(500)] + every
    assert all(quick.findall(text) == whole.findall(text) for text in texts)
    for other in (r"(a)|\s", r"(?i)a", r"\w+", r"[^\S]"):
        assert bpe.ascii_pattern(regex.compile(other)) is not None
        assert isinstance(bpe.ascii_pattern(regex.compile(other)), regex.Pattern)
