"""Each operator against brute force on small tables with nulls, empty and long texts, ties, repeated rows and extra columns; and on empty tables."""

import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from wavemill.llm import common, jaccard, language, licences, lines, media, mix, neighbours, pieces, quality, tokenfile

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size long, score double, line int, node long"
BASE = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen".split()


def near(seed, changes):
    words = [f"w{seed}x{i}" for i in range(120)]
    for c in changes:
        words[c] = f"new{c}"
    return " ".join(words)


TEXTS = [
    near(1, []), near(1, [5]), near(1, [60]), near(1, [5, 90]), near(2, []), near(2, []), near(1, range(0, 120, 3)),
    "", None, "   \n\t ", "short", "short", "one two three four five", "one two three four five six",
    "Une ligne assez longue pour compter.\nAll rights reserved.\nA line that is long enough 1", "A line that is long enough 2\nA line that is long enough 22\nUne ligne assez longue pour compter.",
    "ça va? être été naïve x <|endoftext|> 你好 \x1c ▁ é", " ".join(BASE * 900), "x" * 5000, "!!! ??? 123",
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, ["en", "fr", None][i % 3], ["a", "b", None, "é"][i % 4], len(t or ""), 7, 0.5, 3, 9) for i, t in enumerate(TEXTS)]
    rows += [rows[0], (None, "a row without an id, long enough", "en", "a", 5, 1, 1.0, 1, 1), (None, None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def test_jaccard(docs, empty):
    own = {}
    for r in docs.collect():
        if r["doc_id"] is not None:
            own[r["doc_id"]] = r["text"]
    want = {k: (c, n) for k, c, n in jaccard.brute(list(own.items()))}
    got = jaccard.join(docs).collect()
    assert len(got) == docs.count()
    for r in got:
        if r["doc_id"] is None:
            assert r["class_id"] is None and r["n_links"] == 0
        elif r["doc_id"] != 0 and want[r["doc_id"]][0] != 0:
            assert (r["class_id"], r["n_links"]) == want[r["doc_id"]]
        else:  # document 0 is there twice
            assert (r["class_id"], r["n_links"]) == (want[r["doc_id"]][0], want[r["doc_id"]][1] + 1)
    assert jaccard.join(empty).count() == 0


def jaccard_rows(rows):
    same = [jaccard.set_key(jaccard.shingles(t)) for _, t in rows]
    return [(k, c, n, same.count(same[i])) for i, (k, c, n) in enumerate(jaccard.brute(rows))]


@pytest.mark.parametrize("small,hot,block", [(192, 1024, 512), (8, 40, 30)])
def test_jaccard_large_groups_are_split(spark, monkeypatch, small, hot, block):
    monkeypatch.setattr(jaccard, "SMALL", small)
    monkeypatch.setattr(jaccard, "HOT", hot)
    monkeypatch.setattr(jaccard.blocks, "__defaults__", (block, *jaccard.blocks.__defaults__[1:]))
    rows = [(i, near(7 + i // 420, [i % 120, (i * 7) % 120])) for i in range(460)]
    got = jaccard.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["class_id"], r["n_links"], r["n_copies"]) for r in got) == jaccard_rows(rows)
    assert {r["recall"] for r in got} == {1.0}


def test_jaccard_repeats_runs_until_the_audit_is_content(spark, monkeypatch):
    rows = [(i, near(i // 2, [i % 2 * 7])) for i in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    rounds = []
    find = jaccard.candidate_edges

    def lazy(classes, seeds, known):
        rounds.append(seeds)
        return find(classes, seeds, known) if seeds is None else spark.createDataFrame([], "a long, b long")

    monkeypatch.setattr(jaccard, "candidate_edges", lazy)
    got = jaccard.join(docs).collect()
    assert len(rounds) == 2 * jaccard.ROUNDS + 1 and rounds[-1] is None
    assert sorted((r["doc_id"], r["class_id"], r["n_links"], r["n_copies"]) for r in got) == jaccard_rows(rows)


def test_jaccard_rows_without_an_id_or_with_one_id_for_two_texts(spark):
    rows = [(None, near(1, [])), (None, near(1, [])), (5, near(1, [3])), (7, near(2, [])), (7, near(3, [])), (9, near(3, [50])), (None, near(4, [])), (None, near(4, [9]))]
    got = jaccard.join(spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, h int, cls int")).collect()
    assert sorted(((r["doc_id"] or 0, r["class_id"] or 0, r["n_links"], r["n_copies"], r["first"]) for r in got)) == sorted([(0, 5, 2, 2, False), (0, 5, 2, 2, False), (5, 5, 2, 1, True), (7, 7, 0, 1, True), (7, 7, 1, 1, True), (9, 7, 1, 1, False), (0, 0, 1, 1, True), (0, 0, 1, 1, False)])


def test_neighbours(spark):
    rng = np.random.default_rng(3)
    base = rng.standard_normal((6, 16))
    rows = [(int(i), (base[i % 6] + rng.standard_normal(16) * 0.03).tolist(), int(i % 2)) for i in range(300)]
    rows += [(400, None, 1), (401, [0.0] * 16, 1), (402, [float("nan")] + [1.0] * 15, 1), (403, [None] + [1.0] * 15, 0), (404, [], 0), (405, rows[0][1], None), (406, rows[0][1], 0), (407, rows[0][1][:8], 0), (408, [1e-200] * 16, 1), (409, [1e200] * 16, 1)]
    df = spark.createDataFrame([(*r, 5) for r in rows], "vec_id long, embedding array<double>, label int, id long")
    got = neighbours.near(df)
    assert sorted((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in got.collect()) == neighbours.brute(rows)
    assert neighbours.near(df.limit(0)).count() == 0


def test_neighbours_that_repeat_or_lack_an_id(spark):
    rows = [(1, [1.0, 0.0], 0), (1, [1.0, 0.0], 0), (1, [0.0, 1.0], 0), (2, [0.01, 1.0], 0), (None, [1.0, 0.0], 0), (5, [1.0, 0.0], 1)]
    got = neighbours.near(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert len(got) == 6 and {r["recall"] for r in got} == {1.0}
    assert {(r["vec_id"], r["component_id"], r["kept"]) for r in got} == {(1, 1, True), (2, 1, False), (None, None, False), (5, 5, True)}
    alone = neighbours.near(spark.createDataFrame(rows[3:4], "vec_id long, embedding array<double>, label int")).collect()
    assert [(r["n_links"], r["recall"]) for r in alone] == [(0, None)]


def test_neighbours_of_two_tight_groups(spark):
    rng = np.random.default_rng(4)
    u = rng.standard_normal(64)
    v = rng.standard_normal(64)
    u, v = u / np.sqrt(u @ u), v / np.sqrt(v @ v)
    v = v - (u @ v) * u
    centres = [u, 0.988 * u + np.sqrt(1 - 0.988**2) * v / np.sqrt(v @ v)]
    rows = [(i, (centres[i % 2] + rng.standard_normal(64) * 0.0068).tolist(), 0) for i in range(80)]
    rows += [(i, rng.standard_normal(64).tolist(), 0) for i in range(100, 400)]
    want = neighbours.brute(rows)
    assert min(n for k, n, _, _ in want if k < 80) > 60
    got = neighbours.near(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"))
    assert sorted((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in got.collect()) == want


def test_neighbours_audit_sees_lost_pairs_and_all_are_compared(spark, monkeypatch):
    rng = np.random.default_rng(6)
    rows = []
    for i in range(0, 300, 2):  # pairs without copies
        x = rng.standard_normal(16)
        rows += [(i, x.tolist(), 0), (i + 1, (x + rng.standard_normal(16) * 0.02).tolist(), 0)]
    hot = rng.standard_normal(16)
    rows += [(300, (hot + 0.01).tolist(), 0)] + [(301 + i, hot.tolist(), 0) for i in range(600)]
    lost = spark.createDataFrame([(300, 301, 0.999), (301, 300, 0.999)] + [(i, j, 0.5) for i in range(302) for j in [(i + 7) % 302] if i < 300], "u bigint, v bigint, sim double")
    monkeypatch.setattr(neighbours, "descend", lambda nodes, most, first_tree, known=None: lost)
    monkeypatch.setattr(neighbours, "ATTEMPTS", 1)
    got = neighbours.near(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert sorted((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in got) == neighbours.brute(rows)
    assert {r["recall"] for r in got} == {1.0}


def brute_lines(rows):
    def edit(a, b):
        if a == b:
            return True
        if abs(len(a) - len(b)) > 1:
            return False
        a, b = sorted((a, b), key=len)
        i = next((k for k in range(len(a)) if a[k] != b[k]), len(a))
        return a[i:] == b[i + 1 :] or (len(a) == len(b) and a[i + 1 :] == b[i + 1 :])

    seen, out = [], {}
    for k, t in sorted(rows):
        kept = []
        for part in t.split("\n"):
            s = part.strip(" ")
            if not s or not any(s == x or min(len(s), len(x)) >= lines.LEAST and edit(s, x) for x in seen):
                kept.append(part)
            seen.append(s)
        out[k] = "\n".join(kept)
    return out


def test_lines(spark, docs, empty):
    rng = np.random.default_rng(5)
    made = []
    for i in range(60):
        s = "".join(rng.choice(list("abcd "), 40 + i % 9))
        made.append(s)
        at = int(rng.integers(0, len(s)))
        made.append([s[:at] + s[at + 1 :], s[:at] + "z" + s[at + 1 :], s[:at] + "z" + s[at:], s[:at] + "zz" + s[at:]][i % 4])
    rng.shuffle(made)
    made += ["short", " short ", "", "x", "x", "shorx", "", "  "]
    rows = [(i, "\n".join(made[i * 4 : i * 4 + 4])) for i in range(32)]
    got = {r["doc_id"]: r["text"] for r in lines.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_lines(rows)
    out = lines.dedup(docs)
    assert out.count() == docs.count() and set(out.columns) == {*docs.columns, "n_lines", "n_dropped"}
    assert [r["text"] for r in out.where("doc_id in (14, 15)").orderBy("doc_id").collect()] == [TEXTS[14], ""]
    assert lines.dedup(empty).count() == 0


def test_lines_of_rows_that_repeat_an_id_and_clashing_columns(spark):
    same = "this very line stands in many texts"
    rows = [(1, f"{same}\nthe first text has this line too"), (2, f"{same}\nsecond text of document two is here"), (2, "THIS IS UNIQUE TEXT THAT MUST STAY\nand so is this one"), (2, "THIS IS UNIQUE TEXT THAT MUST STAY\nand so is this one"), (None, f"{same}\nno id"), (None, None)]
    docs = spark.createDataFrame([(*r, 1, 2, 3, 4, 5) for r in rows], "doc_id long, text string, doc int, _gone int, d int, gone int, row int")
    got = lines.dedup(docs)
    assert set(got.columns) == {*docs.columns, "n_lines", "n_dropped"}
    want = [rows[0], (2, "second text of document two is here"), rows[2], rows[2], (None, "no id"), (None, None)]
    assert sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=str) == sorted(want, key=str)
    assert {(r["doc"], r["_gone"], r["d"], r["gone"], r["row"]) for r in got.collect()} == {(1, 2, 3, 4, 5)}


def test_mix(docs, empty):
    out = mix.plan(docs).collect()
    assert len(out) == docs.count()
    total = sum(r["size"] for r in out)
    for r in out:
        assert 0 <= r["taken"] <= 3 * r["size"]
    by = {}
    for r in out:
        a = by.setdefault(r["source"], [0, r["target"]])
        a[0] += r["taken"]
    assert abs(sum(t for _, t in by.values()) - total) < 1e-6 * total
    assert all(abs(n - t) <= max(8, 0.02 * t) for n, t in by.values())
    words = {}
    for r in mix.apply(docs).collect():
        words[r["source"]] = words.get(r["source"], 0) + len((r["text"] or "").replace(" ", "_").replace("\x1c", "_").split())
    assert words == {s: n for s, (n, _) in by.items() if n}
    assert mix.plan(empty).count() == 0 and mix.apply(empty).count() == 0


def test_media(docs, empty):
    for r, t in zip(media.features(media.store_text(docs.orderBy("doc_id"))).collect(), [x["text"] for x in docs.orderBy("doc_id").collect()], strict=True):
        data, n = media.payload_of(t)
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (n, len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-32:]))
    assert media.features(media.store_text(empty)).count() == 0


def plain_feature(payload):
    """The hash by its definition: fold to 24 columns, mean over 32 x 32 cells with shares of samples, cosine transform."""
    rows = [payload[i : i + media.FOLD] for i in range(0, len(payload), media.FOLD)]

    def cells(line):
        out, n = [], len(line)
        for k in range(32):
            a, b = k * n / 32, (k + 1) * n / 32
            out.append(sum(max(0.0, min(b, i + 1) - max(a, i)) * line[i] for i in range(int(a), min(n, int(b) + 1))) * 32 / n)
        return out

    grid = list(zip(*[cells(list(c)) for c in zip(*[cells(list(r)) for r in rows], strict=True)], strict=True))
    cos = np.cos(np.pi * (2 * np.arange(32) + 1)[None, :] * np.arange(8)[:, None] / 64)
    c = np.round(cos @ np.array(grid) @ cos.T / 1024, 6).ravel()
    bits = "".join("1" if x > np.median(c[1:]) else "0" for x in c)
    return f"{int(bits, 2):016x}"


def test_media_of_documents_against_plain_versions(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").orderBy("doc_id").limit(40).collect()
    texts = {r["doc_id"]: r["text"] for r in rows} | {10**9: None, 10**9 + 1: "é" * 4000, 10**9 + 2: "x" * 300_000}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    stored = {r["doc_id"]: bytes(r["png"]) for r in media.store_text(df).collect()}
    same = 0
    for r in media.features(media.store_text(df)).collect():
        data, n = media.payload_of(texts[r["doc_id"]])
        png = stored[r["doc_id"]]
        assert (r["media_bytes"], r["media_sha256"], r["n_bytes"]) == (len(png), hashlib.sha256(png).hexdigest(), n)
        if len(data) < 30_000:
            same += r["feature"] == plain_feature(data)
    assert same >= 0.95 * sum(len(media.payload_of(t)[0]) < 30_000 for t in texts.values())  # ties of coefficients may fall either way


@pytest.mark.parametrize("kind", range(5))
def test_png_filters_and_damage(kind):
    rng = np.random.default_rng(kind)
    x = rng.integers(0, 256, (5, 12), dtype=np.uint8)
    body = bytearray()
    for y in range(5):
        body.append(kind)
        for i in range(12):
            a, b, c = (int(x[y, i - 3]) if i >= 3 else 0), (int(x[y - 1, i]) if y else 0), (int(x[y - 1, i - 3]) if y and i >= 3 else 0)
            p = min((abs(b - c), 0, a), (abs(a - c), 1, b), (abs(a + b - 2 * c), 2, c))[2]
            body.append((int(x[y, i]) - [0, a, b, (a + b) // 2, p][kind]) & 255)
    png = media.SIGNATURE + media._chunk(b"IHDR", b"\0\0\0\x04\0\0\0\x05\x08\x02\0\0\0") + media._chunk(b"IDAT", zlib.compress(bytes(body))) + media._chunk(b"IEND", b"")
    assert (media.decode_png(png) == x).all()
    for at in range(0, len(png) - 1, 3):
        with pytest.raises((ValueError, zlib.error)):
            media.decode_png(png[:at] + bytes([png[at] ^ 1]) + png[at + 1 :])
        with pytest.raises((ValueError, zlib.error)):
            media.decode_png(png[:at])


def test_token_file(spark, docs, empty, tmp_path):
    path = public_tokenizers.path("word_bpe_49k.json")
    tokenfile.write(docs, f"file://{tmp_path}/ids", path, ranges=3)
    got = tokenfile.read(spark, f"file://{tmp_path}/ids").collect()
    assert sorted(((r["doc_id"] is not None, r["doc_id"] or 0, r["start"], r["n_tokens"], zlib.crc32(r["ids"])) for r in got)) == sorted((k is not None, k or 0, s, n, c) for k, s, n, c in tokenfile.brute([(r["doc_id"], r["text"]) for r in docs.collect()], path))
    assert tokenfile.write(empty, f"file://{tmp_path}/none", path) == []
    assert tokenfile.read(spark, f"file://{tmp_path}/none").count() == 0


def test_pieces(spark, docs, empty):
    path = public_tokenizers.path("piece_bpe_32k.model")
    own = pieces.model(path)
    for r in pieces.encode(docs, path).join(docs.select("doc_id", "text").dropDuplicates(), "doc_id").collect():
        text = r["text"] or ""
        assert r["ids"] == own.sp.encode(text) and own.decode(r["ids"]) == text.replace("▁", " ")
        assert all(own.decode(x) == text.replace("▁", " ") for x in r["next_ids"])
        assert len(r["scores"]) == len(r["next_ids"]) + 1 and r["scores"] == sorted(r["scores"], reverse=True) and r["scores"][0] == 0
        assert len({tuple(r["ids"]), *map(tuple, r["next_ids"])}) == len(r["scores"])
    assert pieces.encode(empty, path).count() == 0 and pieces.digest(empty, path).count() == 0


def test_pieces_are_the_librarys_on_every_document(spark):
    path = public_tokenizers.path("piece_bpe_32k.model")
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    want = {r["doc_id"]: pieces.model(path).sp.encode(r["text"] or "") for r in rows.collect()}
    got = pieces.digest(rows, path).collect()
    assert len(got) == len(want)
    assert all((r["n_pieces"], r["ids_crc32"]) == (len(want[r["doc_id"]]), zlib.crc32(np.asarray(want[r["doc_id"]], "<u4").tobytes())) and r["exact"] for r in got)
    assert max(len(r["crcs"]) for r in got) == pieces.BEST


def test_only_words_of_least_bounds_are_weighed(spark, monkeypatch):
    m = pieces.Pieces(public_tokenizers.path("piece_bpe_32k.model"))
    texts = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect() if r["text"]]
    texts += ["the in the of", "日本 the\n語 in é", "a", "   x", "\n\n ▁", "the " * 50]
    plain, calls = m.loss, []
    monkeypatch.setattr(m, "loss", lambda chunk, ids: calls.append(chunk) or plain(chunk, ids))
    known = {}
    for t in texts:
        words = pieces._CHUNK.findall("▁" + t.replace(" ", "▁"))
        for c in words:
            if c not in known:
                known[c] = plain(c, m.own(c))
                ids = np.array(m.own(c))
                assert m.bounds(ids).min() <= known[c] or known[c] > m.bound
        want = sorted(sorted([x for x in range(len(words)) if known[words[x]] < np.inf], key=lambda x: (known[words[x]], x))[:3])
        assert [w for _, _, w in m.least("▁" + t.replace(" ", "▁"), np.array(m.sp.encode(t)), 3)] == [words[x] for x in want]
    assert len(calls) < 0.15 * len(known)


def test_one_very_long_word():
    m = pieces.model(public_tokenizers.path("piece_bpe_32k.model"))
    text = "abcdefgh" * 20_000
    got = m.encode(text, 2)
    assert got[0][1] == m.sp.encode(text) and m.decode(got[1][1]) == text and got[1][0] < got[0][0]


def test_nbest_is_exact():
    import random

    random.seed(4)

    def every(m, text):
        def go(i, s):
            if i == len(text):
                yield s
            for j in range(i + 1, len(text) + 1):
                if text[i:j] in m.score:
                    yield from go(j, s + m.score[text[i:j]])
                elif j == i + 1:
                    yield from go(j, s + m.unknown)

        return sorted(go(0, 0.0), reverse=True)

    for _ in range(200):
        m = pieces.Pieces(scores={random.choice(["", "▁"]) + "".join(random.choices("abc", k=random.randint(1, 3))): -random.randint(1, 20) for _ in range(9)})
        text = "".join(random.choices("abcd ", k=random.randint(1, 8)))
        for most in (1, 2, 5):
            assert [s for s, _ in m.encode(text, most)] == pytest.approx(every(m, "▁" + text.replace(" ", "▁"))[:most])


def test_language(spark, docs, empty):
    en, fr = "the quick brown fox jumps over the lazy dog again and again ", "le vif renard brun saute par dessus le chien paresseux encore "
    rows = [(i, (en if i % 2 else fr) * 3, "en" if i % 2 else "fr") for i in range(60)] + [(100, None, "en"), (101, "", None), (102, "123 !!", "fr"), (103, "the lazy fox over", None), (104, "le chien brun", None)]
    df = spark.createDataFrame([(*r, 0.1) for r in rows], "doc_id long, text string, lang string, score double")
    got = {r["doc_id"]: r for r in language.identify(df, language.sample(df)).collect()}
    assert all(got[i]["lang_pred"] == ("en" if i % 2 else "fr") for i in range(60))
    assert [got[i]["lang_pred"] for i in range(100, 105)] == ["und", "und", "und", "en", "fr"]
    assert language.identify(empty, {}).count() == 0 and language.identify(docs, {}).where("lang_pred <> 'und'").count() == 0


def plain_phrases(text, learnt):
    n, at = 0, 0
    while at < len(text):
        end = at + 1
        while end < len(text) and any(text[at : end + 1] in t for t in learnt):
            end += 1
        n, at = n + 1, end
    return n


@pytest.mark.parametrize("own,block,lanes", [(96, 1024, 2048), (2, 7, 3), (0, 1, 2)])
def test_phrases_are_longest_matches_across_blocks(monkeypatch, own, block, lanes):
    monkeypatch.setattr(language, "OWN_LETTERS", own)
    monkeypatch.setattr(language, "BLOCK", block)
    monkeypatch.setattr(language, "LANES", lanes)
    rng = np.random.default_rng(9)
    learnt = [["".join(rng.choice(list(abc), 30)) for _ in range(4)] for abc in ("abc", "abde", "你好吗a")]
    p = language.Parser(tuple((str(i), tuple(x)) for i, x in enumerate(learnt)))
    texts = ["".join(rng.choice(list("abcdez你好"), int(rng.integers(1, 90)))) for _ in range(40)] + ["", "ab" * 60, "a" * 100, "z" * 50]
    got = p.phrases([p.code(t) for t in texts])
    assert got.tolist() == [[plain_phrases(t, x) for x in learnt] for t in texts]


def test_language_of_long_texts_and_ties(spark):
    learnt = {"aa": ["the quick brown fox jumps over the lazy dog"], "bb": ["the quick brown fox jumps over the lazy dog"], "cc": ["portez ce vieux whisky au juge blond qui fume"]}
    rows = [(1, "whisky blond au juge " * 3000), (2, "the lazy fox"), (None, "the lazy fox"), (3, "1 2 3")]
    p = language.Parser(tuple((k, tuple(v)) for k, v in sorted(learnt.items())))
    got = {(r["doc_id"], r["lang_pred"], r["score"]) for r in language.identify(spark.createDataFrame(rows, "doc_id long, text string"), learnt).collect()}
    code = [p.code(t) for _, t in rows[:2]]
    plain = [["".join(map(chr, c + 200)) for c in map(p.code, ts)] for _, ts in sorted(learnt.items())]
    rates = [[plain_phrases("".join(map(chr, c + 200)), x) * s / len(c) for x, s in zip(plain, p.scale, strict=True)] for c in code]
    assert {(k, pred) for k, pred, _ in got} == {(1, "cc"), (2, "aa"), (None, "aa"), (3, "und")}
    assert next(s for k, _, s in got if k == 1) == pytest.approx(rates[0][0] / (rates[0][0] + rates[0][2]))
    assert next(s for k, _, s in got if k == 2) == 0.5


def test_quality(spark, docs, empty):
    good = ["It was a plain day, and nothing much happened to anyone. We walked home " + f"by road {i} and slept." for i in range(60)]
    bad = ["BUY!! NOW!! " * (3 + i % 7) + "$$$ ### " * (i % 5) for i in range(60)]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(good + bad)] + [(500, None, 1), (501, "", 1), (None, "x", 1)], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(i, int(i < 60), 0) for i in range(120)] + [(0, 1, 0), (1, None, 0), (None, 1, 0), (2, 0, 0)], "doc_id long, quality int, toxic int")
    model, stats = quality.train(df, labels)
    got = {r["doc_id"]: r["score"] for r in quality.score(stats, model).collect()}
    assert len(got) == 123 and all(0 <= s <= 1 for s in got.values())
    assert sum((got[i] >= 0.5) == (i < 60) for i in range(120)) >= 118
    assert quality.keep_good(df, labels).columns == df.columns
    for some in (labels.limit(0), labels.where("quality = 1")):
        assert quality.score(stats, quality.fit(stats, some)).count() == 123
    model, stats = quality.train(empty, labels)
    assert quality.score(stats, model).count() == 0


def test_quality_against_plain_densities(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    mark = {r["doc_id"]: r["quality"] for r in labels.collect()}
    x = {k: np.array(quality.statistics(t)) / quality.GRAIN for k, t in texts.items()}
    learn = {y: np.array([x[k] for k in x if mark.get(k) == y and zlib.crc32(str(k).encode()) % 3 != 1]) for y in (0, 1)}
    cov = {y: np.cov(v.T, bias=True) for y, v in learn.items()}
    n = {y: len(v) for y, v in learn.items()}
    pooled = (n[0] * cov[0] + n[1] * cov[1]) / (n[0] + n[1])
    log = {}
    for y in (0, 1):
        s = (1 - quality.POOLED - quality.DIAGONAL) * cov[y] + quality.POOLED * pooled + quality.DIAGONAL * (np.diag(np.diag(pooled)) + quality.FLOOR * np.eye(len(quality.NAMES)))
        log[y] = {k: -0.5 * (v - learn[y].mean(axis=0)) @ np.linalg.solve(s, v - learn[y].mean(axis=0)) - 0.5 * np.linalg.slogdet(s)[1] + np.log(n[y]) for k, v in x.items()}
    got = quality.op10_quality(spark, sf).collect()
    assert len(got) == len(texts)
    for r in got:
        k = r["doc_id"]
        assert r["held_out"] == (zlib.crc32(str(k).encode()) % 3 == 1) and r["predicted"] == (r["score"] >= 0.5)
        assert r["score"] == pytest.approx(1 / (1 + np.exp(np.clip(log[0][k] - log[1][k], -500, 500))), abs=1e-6)
    held = [(r["predicted"], mark[r["doc_id"]]) for r in got if r["held_out"] and r["doc_id"] in mark]
    assert sum(a == b for a, b in held) >= 0.95 * len(held)


def test_quality_of_long_texts_ties_and_repeats(spark):
    docs = spark.createDataFrame([(1, "plain words here " * 50_000, 1), (2, "same", 1), (2, "same", 2), (3, None, 1), (4, "", 1)], "doc_id long, text string, stats int")
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0)], "doc_id long, quality int, toxic int")
    model, stats = quality.train(docs, labels)
    got = sorted(((r["doc_id"], r["score"]) for r in quality.score(stats, model).collect()))
    assert len(got) == 5 and got[1] == got[2] and got[3][1] == got[4][1]


def test_licences(spark, empty):
    rows = [
        ("a/LICENSE", "Released under the MIT License."), ("a/b/COPYING", "x\nLicensed under the Apache License, Version 2.0.\ny"), ("a/b/c/f.txt", "nothing"), ("a/g.txt", "words"),
        ("h.txt", "All rights reserved."), ("i.txt", None), (None, "x"), ("a/b/z.txt", "Licensed under CC BY-NC 4.0."), ("q/r.txt", ""), ("a/g.txt", "words"),
    ]
    got = [(r["path"], r["licence"], r["via"]) for r in licences.scan(spark.createDataFrame([(*r, 1.0) for r in rows], "path string, text string, cosine double")).collect()]
    assert sorted(got, key=str) == sorted([
        ("a/LICENSE", "MIT", "own"), ("a/b/COPYING", "Apache-2.0", "own"), ("a/b/c/f.txt", "Apache-2.0", "a/b/COPYING"), ("a/g.txt", "MIT", "a/LICENSE"), ("a/g.txt", "MIT", "a/LICENSE"),
        ("h.txt", "Proprietary", "own"), ("i.txt", None, None), (None, None, None), ("a/b/z.txt", "CC-BY-NC-4.0", "own"), ("q/r.txt", None, None),
    ], key=str)
    assert licences.scan(empty.select(F.col("source").alias("path"), "text")).count() == 0


def test_licences_whole_files_and_inline_notices(spark):
    mit = licences_of("MIT").replace("Copyright (c)", "Copyright (c) 2031 Someone Else,", 1)
    bsd3 = licences_of("BSD-3-Clause")
    prose = "we went down to the old harbour that morning and nobody there had seen a boat for days "
    rows = [
        ("a/LICENSE", mit), ("a/x.txt", "words"), ("b/LICENSE", bsd3), ("b/x.txt", "words"), ("c/LICENSE", licences_of("BSD-2-Clause")), ("d.txt", prose + "Licensed under the Apache License, Version 2.0."),
        ("e.txt", prose + "licensed under\nthe Apache License, Version 2.0. " + prose), ("f.txt", prose + "with permission"), ("g/LICENSE", licences_of("GPL-3.0").replace("GNU General", "GNU Affero General")),
    ]
    got = {r["path"]: (r["licence"], r["via"]) for r in licences.scan(spark.createDataFrame(rows, "path string, text string")).collect()}
    assert got.pop("g/LICENSE")[0] != "GPL-3.0"
    assert got == {
        "a/LICENSE": ("MIT", "own"), "a/x.txt": ("MIT", "a/LICENSE"), "b/LICENSE": ("BSD-3-Clause", "own"), "b/x.txt": ("BSD-3-Clause", "b/LICENSE"), "c/LICENSE": ("BSD-2-Clause", "own"),
        "d.txt": ("Apache-2.0", "own"), "e.txt": ("Apache-2.0", "own"), "f.txt": (None, None),
    }


def licences_of(name):
    from wavemill.llm.licence_texts import FULL

    return FULL[name]


def brute_licence(matcher, text):
    """Best cosine over every span of every notice's length, each line, and the whole licences, one by one."""
    words = licences.terms(text or "")

    def cosine(some, w, m):
        v, norm = matcher.vector(" ".join(some))
        return sum(x * w.get(t, 0.0) for t, x in v.items()) / (norm * m) if norm else 0.0

    top = max(((round(cosine(words, w, m), 9), name) for name, w, m in matcher.full), default=(0, "")) if words else (0, "")
    if top[0] >= licences.LEAST:
        return top[1]
    found = []
    for (name, w, m), size in zip(matcher.templates, [len(licences.terms(x)) for n in sorted(licences.TEMPLATES) for x in licences.TEMPLATES[n]], strict=True):
        found += [(round(cosine(words[i : i + size], w, m), 9), size, name) for i in range(len(words) - size + 1)]
    return max(found, default=(0, 0, ""))[2] if max(found, default=(0,))[0] >= licences.LEAST else None


def test_licences_against_every_span(spark):
    rows = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    rows = [t[:3000] for t in rows if t and len(t) < 9000][:60]
    made = ["# SPDX-License-Identifier: GPL-3.0-or-later\ncode", "# Licensed under GPLv3", "Apache 2.0", "x released under the MIT license y", "licensed under mozilla public licence"]
    total, df = 100, {t: 3 + i % 20 for i, t in enumerate(sorted(licences.VOCABULARY))}
    matcher = licences.Matcher(total, df)
    got = [matcher.scan(t)[0] for t in made]
    assert got[:4] == ["GPL-3.0", "GPL-3.0", "Apache-2.0", "MIT"]
    for t in rows + made:
        want = brute_licence(matcher, t)
        assert want is None or matcher.scan(t)[0] is not None  # runs of lines may add notices, spans lose none
    for name in ("MIT", "Apache-2.0", "GPL-3.0", "BSD-3-Clause"):
        assert matcher.scan(licences_of(name))[0] == name


def test_licences_with_ties_and_without_ids(spark):
    rows = [(1, "a/LICENSE", "MIT License"), (2, "a/COPYING", "Released under the MIT License."), (None, "a/x", "plain"), (3, "a/b/y", "word " * 20000), (None, None, None)]
    got = licences.scan(spark.createDataFrame(rows, "doc_id long, path string, text string"), ("doc_id",)).collect()
    assert len(got) == 5
    assert {(r["doc_id"], r["path"], r["licence"], r["via"]) for r in got} == {(1, "a/LICENSE", "MIT", "own"), (2, "a/COPYING", "MIT", "own"), (None, "a/x", "MIT", "a/COPYING"), (3, "a/b/y", "MIT", "a/COPYING"), (None, None, None, None)}


def test_licence_query_inherits_from_documents_that_are_licences(spark, tmp_path):
    notice = "This work is licensed under the GNU General Public License, version 3."
    prose = "we went down to the old harbour that morning and nobody there had seen a boat for days "
    rows = [
        (1, licences_of("MIT"), "en", "s1"), (2, "words", "en", "s1"), (3, "words", "fr", "s1"), (4, notice, "en", "s2"), (5, None, "en", "s2"), (6, prose + notice, "en", "s3"), (7, "words", "en", "s3"),
        (8, licences_of("BSD-2-Clause"), "en", None), (9, "words", "en", None), (10, "All rights reserved.", None, "s4"), (11, "words", None, "s4"), (12, "words", "en", "s4"), (None, "words", "en", "s2"),
    ]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = [(r["doc_id"], r["licence"], r["via"]) for r in licences.op3_licences(spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == sorted([
        (1, "MIT", "own"), (2, "MIT", "s1/en/1"), (3, None, None), (4, "GPL-3.0", "own"), (5, "GPL-3.0", "s2/en/4"), (6, "GPL-3.0", "own"), (7, None, None),
        (8, "BSD-2-Clause", "own"), (9, None, None), (10, "Proprietary", "own"), (11, "Proprietary", "s4/none/10"), (12, None, None), (None, "GPL-3.0", "s2/en/4"),
    ], key=str)


def test_licences_alone_in_a_text():
    total, df = 100, {t: 3 + i % 20 for i, t in enumerate(sorted(licences.VOCABULARY))}
    matcher = licences.Matcher(total, df)
    assert all(matcher.alone(x, name) for name, texts in licences.TEMPLATES.items() for x in texts)
    assert all(matcher.alone(x, name) for name, x in licences.FULL.items())
    agpl = licences_of("GPL-3.0").replace("GNU General", "GNU Affero General")
    assert not matcher.alone("MIT License " + "word " * 50, "MIT") and not matcher.alone("MIT License", "GPL-3.0") and not matcher.alone(agpl, "GPL-3.0")


def test_materialize_relieves_the_driver_when_due(spark, monkeypatch):
    """Plans leave garbage in the driver: written tables end with a full collection, but no more often than RELIEF_S allows."""
    jvm = spark.sparkContext._jvm
    monkeypatch.setattr(common, "RELIEF_SHARE", 1.0)

    def full() -> int:
        return sum(b.getCollectionCount() for b in jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans() if "Old" in b.getName() or "MarkSweep" in b.getName())

    common._relief_due[0], before = 0.0, full()
    assert common.materialize(spark.range(3), "relief").count() == 3
    assert full() > before
    assert not common.relieve(spark)  # not due again
    common._relief_due[0] = 0.0
    assert common.relieve(spark)
