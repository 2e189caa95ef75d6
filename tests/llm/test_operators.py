"""Every operator against a brute-force version, and its defined cases: nulls, empty and long texts, ties, repeated rows,
empty tables, extra columns of clashing names."""

import hashlib
import json
import base64

import duckdb
import numpy as np
import pytest
import xxhash

from quillmark.llm import decontaminate, fingerprints, language_id, line_dedup, mixing, quality, secrets, simhash, substring_dedup, url_filter

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, k string, t string, h1 int, bucket int, size int, fp string, v string"
LONG = " ".join(f"word{i % 977} the of and" for i in range(20_000))
SHARED = "this very passage of well over fifty bytes stands in several of the documents as it is"


def documents(spark, rows):
    return spark.createDataFrame([(i, t, "en" if i is None or i % 2 else "de", s, len(t or ""), "k", "t", 1, 2, 3, "fp", "v") for i, t, s in rows], SCHEMA)


@pytest.fixture(scope="module")
def rows():
    out = [(i, f"Number {i} has its own words here {i * 7919 % 1000} and {i * 31} goes on.\nA line of text number {i}, with eight words or more in it.", f"s{i % 3}") for i in range(1, 40)]
    out += [(40, None, "s1"), (41, "", "s1"), (42, "   \n\t ", None), (43, LONG, "s0"), (44, out[2][1], "s2"), (44, out[2][1], "s2"), (45, out[2][1] + " x", None)]
    out += [(46, f"Before. {SHARED}. After.", "s1"), (47, f"{SHARED} and more", "s1"), (48, f"é {SHARED[:70]}!", "s2"), (None, f"no id, {SHARED}", "s2"), (49, "ü", "s0")]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return documents(spark, rows)


@pytest.fixture(scope="module")
def none(spark):
    return documents(spark, [])


def collected(df):
    return sorted(map(tuple, df.collect()), key=repr)


# 1 language ID


def test_language(spark):
    words = {"en": "the of and thing with that from this have", "de": "der und nicht eine schwer über kein durch", "fr": "le les été que pour dans avec être"}
    rng = np.random.default_rng(1)
    rows = [(i, " ".join(rng.choice(words[lang].split(), 12)), lang) for i, lang in enumerate(list(words) * 60)]
    df = spark.createDataFrame([*rows, (900, None, "en"), (901, "12 34 !!", "de"), (902, "", None), (None, rows[0][1], "en")], "doc_id long, text string, lang string")
    model = language_id.train(df.where(~language_id.held_out()))
    got = {r.doc_id: r for r in language_id.identify(df, model).collect()}
    assert len(got) == df.count()
    assert np.mean([got[i].lang_pred == lang for i, _, lang in rows if i in got]) > 0.97
    assert [got[i].lang_pred for i in (900, 901, 902)] == ["und"] * 3 and got[900].score == 0
    assert all(0 <= r.score <= 1 for r in got.values())
    kept = language_id.filter_known(df, model)
    assert kept.columns == df.columns and not {900, 901, 902} & {r.doc_id for r in kept.collect()} and kept.count() > 175
    nothing = language_id.train(df.where("false"))
    assert {r.lang_pred for r in language_id.identify(df, nothing).collect()} == {"und"}
    assert language_id.identify(df.where("false"), model).count() == 0
    one = language_id.train(df.where("lang = 'en'"))
    assert {r.lang_pred for r in language_id.identify(df.where("doc_id < 9"), one).collect()} == {"en"}


@pytest.mark.parametrize("k", [2, 3, 4, 6, 9, 30])
def test_codewords_differ(k):
    code = language_id.codewords(k).astype(int)
    apart = (code.shape[1] - code @ code.T) // 2
    assert (apart[~np.eye(k, dtype=bool)] >= max(1, code.shape[1] // 5)).all()


# 2 quality


def test_quality(spark, docs, none):
    rng = np.random.default_rng(2)
    good = lambda: " ".join(rng.choice("a plain sentence of ordinary words follows another one".split(), 30)) + "."
    bad = lambda: " ".join(w + "###" for w in rng.choice("A PLAIN SENTENCE OF ORDINARY WORDS".split(), 30))
    df = spark.createDataFrame([(i, good() if i % 3 else bad()) for i in range(300)] + [(900, None), (901, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(200)] + [(901, None, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    model = quality.train(df, labels)
    assert model.pairs
    got = {r.doc_id: r for r in quality.score(df, model).collect()}
    assert all(got[i].predicted == int(i % 3 > 0) for i in range(200, 300))
    assert got[900].score == got[901].score and all(0 <= r.score <= 1 for r in got.values())
    unlearnt = quality.train(df, labels.where("false"))
    assert {r.score for r in quality.score(df, unlearnt).collect()} == {0.5}
    assert quality.score(none, model).count() == 0 and quality.score(docs, model).count() == docs.count()


def test_quality_score_adds_tables():
    x = np.random.default_rng(3).normal(size=(500, len(quality.FEATURES)))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)
    model = quality.fit(x, y)
    assert ((model.score(x) > 0.5) == y).mean() > 0.9  # only a pair tells


# 3 decontamination


def brute_hits(text, items, size=10):
    w = decontaminate.words(text)
    hit, found = set(), set()
    for item, t in items:
        q = decontaminate.words(t)
        for s in [q[i : i + size] for i in range(max(1, len(q) - size + 1))] if q else []:
            for at in range(len(w) - len(s) + 1):
                if w[at : at + len(s)] == s:
                    hit.update(range(at, at + len(s)))
                    found.add(item if item is not None else "")
    return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()


@pytest.mark.parametrize("block", [200_000, 7])
def test_decontaminate(spark, rows, docs, none, block):
    text = "one two three four five six seven eight nine ten eleven twelve"
    more = [(60, f"x {text.upper()}, y", "s"), (61, f"{text} {text}", "s"), (62, text.replace("six", "SIX-six"), "s"), (63, "short one?", "s"), (64, "a a a a", "s")]
    items = [("b", text), ("a", "short ONE"), ("c", "a a"), ("d", None), ("e", "..."), ("a", text[4:]), (None, "own words"), ("f", SHARED)]
    df = documents(spark, rows + more).orderBy("text")
    benchmark = spark.createDataFrame(items, "item_id string, text string")
    got = decontaminate.decontaminate(df, benchmark, block=block)
    want = sorted(((i, *brute_hits(t, items)) for i, t, _ in rows + more), key=repr)
    assert sorted(((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256) for r in got.collect()), key=repr) == want
    assert all(r.contaminated == (r.n_hit > 0) for r in got.collect())
    assert decontaminate.decontaminate(none, benchmark, block=block).count() == 0
    assert decontaminate.decontaminate(df, benchmark.where("false")).where("contaminated").count() == 0
    kept = decontaminate.drop_contaminated(df, benchmark)
    assert kept.columns == df.columns and kept.count() == sum(w[2] == 0 for w in want)


def test_proximity(spark):
    df = spark.createDataFrame([(1, "red x green y blue"), (2, "red " + "x " * 30 + "green blue")], "doc_id long, text string")
    got = {r.doc_id: r for r in decontaminate.decontaminate(df, spark.createDataFrame([("q", "red green blue")], "item_id string, text string")).collect()}
    assert got[1].n_near == 1 and got[1].n_hit == 0 and got[2].n_near == 0


# 4 secrets


def der(tag, body):
    n = len(body)
    size = bytes([n]) if n < 128 else bytes([0x80 | ((n.bit_length() + 7) // 8)]) + n.to_bytes((n.bit_length() + 7) // 8, "big")
    return bytes([tag]) + size + body


def test_secrets(spark, docs, none):
    number = lambda i: der(2, bytes([0x40 + i] * 40))
    pkcs1 = der(0x30, der(2, b"\0") + b"".join(map(number, range(8))))
    pkcs8 = der(0x30, der(2, b"\0") + der(0x30, der(6, b"\x2a\x86\x48\x86\xf7\x0d\x01\x01\x01") + der(5, b"")) + der(4, pkcs1))
    url = lambda o: base64.urlsafe_b64encode(json.dumps(o).encode()).decode().rstrip("=")
    jwt = f"{url({'alg': 'HS256', 'typ': 'JWT'})}.{url({'sub': 'x'})}.c2lnbmF0dXJl"
    b64 = base64.b64encode(pkcs8).decode()
    pem = "-----BEGIN PRIVATE KEY-----\n" + b64[:64] + "\n" + b64[64:] + "\n-----END PRIVATE KEY-----"
    cases = {
        1: (f"ü {jwt}!", "jwt"), 2: (f"key {b64} end", "der"), 3: (pkcs1.hex(), "hexder"), 4: (pem, "pem"),
        5: (base64.b64encode(b"0" + bytes(80)).decode(), None), 6: (jwt.replace(jwt[:20], "eyJ" + "A" * 17), None), 7: (b64[:-8], None),
    }
    df = spark.createDataFrame([(i, t) for i, (t, _) in cases.items()] + [(8, None), (9, "")], "doc_id long, text string")
    got = {r.doc_id: r for r in secrets.scan(df).collect()}
    for i, (text, kind) in cases.items():
        assert (got[i].n_confirmed > 0) == (kind is not None), i
        assert kind is None or f"{kind}:" in got[i].spans
    assert got[1].spans == f"jwt:2:{2 + len(jwt)}"
    empty = hashlib.sha256(b"").hexdigest()
    assert got[8].base_sha256 == got[9].base_sha256 == empty and got[8].spans == ""
    assert secrets.scan(none).count() == 0 and secrets.scan(docs).count() == docs.count()


def test_base_secrets(spark):
    text = "é PassWord = 'hunter22' tokén token:abc secret: token: abcdef AKIA" + "B" * 16 + " AKIAshort " + "0123456789abcdef" * 2 + " api_key=xyz123"
    r = secrets.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    a, z = text.index("PassWord"), text.index("'hunter22'") + 9
    # "secret: token" has a value of five letters, is dropped, and its letters are used up
    assert (r.n_assign, r.n_access, r.n_hex) == (2, 1, 1)
    assert r.spans.startswith(f"assign:{a}:{z},access:")


# 5 fingerprints


def brute_syncmers(text, k=fingerprints.K, s=fingerprints.S):
    c = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64) + np.uint64(1)
    h = fingerprints._mixed(fingerprints._grams(c, s))
    out = []
    for i in range(len(c) - k + 1):
        w = h[i : i + k - s + 1]
        if w[0] == w.min() or w[-1] == w.min():
            out.append(i)
    return out


def test_syncmers_are_closed_and_context_free():
    text = "it was näturally a rather ordinary sentence, which was 日本 then repeated: a rather ordinary sentence, which was"
    _, at = fingerprints.anchors(text)
    assert at.tolist() == brute_syncmers(text)
    h, at = fingerprints.anchors(text)
    again = [h[at == text.index(p) + 10].tolist() == h[at == text.rindex(p) + 10].tolist() for p in ["a rather ordinary sentence, which was"]]
    assert all(again)


def test_fingerprint(spark, rows, docs, none):
    got = {}
    for r in fingerprints.fingerprint(docs).collect():
        got.setdefault(r.doc_id, []).append(r)
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    assert sum(map(len, got.values())) == len(rows)
    for n, (i, text, _) in enumerate(order):
        text, following = text or "", order[(n + 1) % len(order)][1] or ""
        changed = fingerprints.edited(text, following)
        assert any(r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(changed.encode()).hexdigest() for r in got[i]), i
        a, b, c = (fingerprints.sketch(x) for x in (text, changed, following))
        assert any(r.near_edited == fingerprints.likeness(a, b) and r.near_next == fingerprints.likeness(a, c) for r in got[i])
    assert got[3][0].fingerprint == got[44][0].fingerprint and got[41][0].fingerprint == ""
    assert fingerprints.fingerprint(none).count() == 0
    alone = fingerprints.fingerprint(docs.where("doc_id = 1")).first()
    assert alone.near_next == 1.0


# 6 substrings


def brute_removed(rows, length=50):
    by = {}
    for i, t, _ in rows:
        if i is not None:
            b = (t or "").encode()
            for at in range(len(b) - length + 1):
                w = b[at : at + length]
                by[w] = min(by.get(w, i), i)
    out = []
    for i, t, _ in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for at in range(len(b) - length + 1) if i is not None else ():
            if by[b[at : at + length]] < i:
                gone[at : at + length] = True
        out.append((i, len(b), int(gone.sum()), int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum()), hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()))
    return sorted(out, key=repr)


def test_substrings(spark, rows, docs, none):
    assert collected(substring_dedup.dedup(docs)) == brute_removed(rows)
    assert substring_dedup.dedup(none).count() == 0


def test_substrings_of_few_letters(spark):
    rng = np.random.default_rng(4)
    blocks = ["".join(rng.choice(list("ab\0é"), 60)) for _ in range(6)]
    rows = [(i, "".join(blocks[j][rng.integers(0, 20) :] for j in rng.integers(0, 6, 4)), "s") for i in range(40)] + [(50, "a" * 300, "s"), (51, "a" * 120, "s")]
    df = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    assert collected(substring_dedup.dedup(df)) == brute_removed(rows)


@pytest.mark.parametrize("hot, split", [(2, 10_000), (10_000, 2), (0, 0), (3, 5)])
def test_substrings_of_hot_anchors(spark, hot, split):
    """A phrase with other surroundings in each document, longer and shorter than a window, and repeats of both."""
    rng = np.random.default_rng(6)
    word = lambda n: "".join(rng.choice(list("abcdefghij klmnoé"), n))
    phrases, tails = [word(45), word(64), word(30)], [word(3) for _ in range(4)]
    rows = [(int(i), word(40) + phrases[i % 3] + tails[rng.integers(4)] + word(25) + phrases[1] * int(i % 7 == 0), "s") for i in rng.permutation(90)]
    rows += rows[:6] + [(3, rows[10][1], "s"), (200, rows[11][1], "s"), (None, phrases[1] * 2, "s"), (201, None, "s"), (202, phrases[1] * 40, "s")]
    df = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string").repartition(5)
    assert collected(substring_dedup.dedup(df, hot=hot, split=split, bucket_bytes=500)) == brute_removed(rows)


@pytest.mark.parametrize("letters, length", [(2, 5), (3, 7), (250, 20), (4, 50)])
def test_interval_expansion(letters, length):
    rng = np.random.default_rng(5)
    text = rng.integers(0, letters, 400).astype(np.int16)
    text[200:280] = text[20:100]
    order, group = substring_dedup.equal_windows(text, length)
    windows = [tuple(np.roll(text, -i)[:length]) for i in order]
    assert windows == sorted(windows)
    assert all((a == b) == (g == h) for a, b, g, h in zip(windows, windows[1:], group, group[1:]))


# 7 mixing


def test_mix(spark, rows, docs, none):
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r.source, []).append(r)
    total = sum(r.size for r in got)
    assert sorted(map(repr, by)) == sorted(map(repr, {s for _, _, s in rows}))
    left, open_, targets = float(total), {s: i % 3 + 1 for i, s in enumerate(sorted(by, key=lambda s: (s is None, s or "")))}, {}
    while open_:
        weight = sum(open_.values())
        full = [s for s, w in open_.items() if left * w / weight >= 3 * by[s][0].source_size]
        if not full:
            targets |= {s: left * w / weight for s, w in open_.items()}
            break
        for s in full:
            targets[s] = 3.0 * by[s][0].source_size
            left -= targets[s]
            del open_[s]
    for s, rs in by.items():
        assert rs[0].source_size == sum(r.size for r in rs)
        assert abs(rs[0].target - targets[s]) < 1e-6 and abs(sum(r.taken for r in rs) - targets[s]) <= 0.5
        assert all(0 <= r.taken <= 3 * r.size for r in rs)
    assert collected(mixing.mix(docs)) == collected(mixing.mix(docs.repartition(7)))
    assert mixing.mix(none).count() == 0
    assert all(r.target == 0 for r in mixing.mix(docs.where("doc_id in (40, 41)")).collect())


# 8 SimHash


def brute_fingerprint(text, n=4):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + n]), 42) for i in range(max(1, len(w) - n + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(ids, fps, within=4):
    root = list(range(len(ids)))
    for i in range(len(ids)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= within:
                a, b = root[i], root[j]
                root = [b if r == a else r for r in root]
    least = {}
    for r, i in zip(root, ids):
        if i is not None:
            least[r] = min(least.get(r, i), i)
    return [least.get(r) for r in root]


def test_simhash(spark, rows, docs, none):
    fps = [brute_fingerprint(t) for _, t, _ in rows]
    want = sorted(((i, f"{f:016x}", c) for (i, _, _), f, c in zip(rows, fps, brute_components([i for i, _, _ in rows], fps))), key=repr)
    assert collected(simhash.components(docs)) == want
    assert simhash.components(none).count() == 0
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted({c for i, _, c in want if i is not None and c is not None})


@pytest.mark.parametrize("split", [20_000, 30])
def test_links_join_all_within_reach(spark, split):
    rng = np.random.default_rng(6)
    base = int(rng.integers(0, 1 << 63))
    near = {base ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 5), replace=False)) for _ in range(120)}
    far = {int(x) for x in rng.integers(0, 1 << 62, 200)}
    fps = sorted(near | far | {f ^ 0b1111 for f in list(far)[:20]})
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    got = simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long"), split=split).collect()
    root = {f: f for f in signed}
    for a, b in got:
        assert bin((a ^ b) & (1 << 64) - 1).count("1") <= 4
        ra, rb = root[a], root[b]
        root = {f: rb if r == ra else r for f, r in root.items()}
    want = brute_components(list(range(len(fps))), fps)
    groups = lambda labels: {frozenset(i for i, x in enumerate(labels) if x == v) for v in set(labels)}
    assert groups([root[f] for f in signed]) == groups(want)


# 9 URLs


def test_urls(spark):
    rows = [
        (1, "https://WWW.Example.com/en/7817?x=1"), (2, "http://a.com/en/1"), (3, "http://com/en/"), (4, "http://xcom/en/1"), (5, "http://m.example.net/de/81"), (6, "http://m.example.net/de/71"),
        (7, "ftp://x.org/es/#f"), (8, None), (9, "no scheme"), (10, "http://h?q=/en/"), (11, "https://poker-betting.example.org/fr/1"), (12, "https://weather.example.org/fr/1"), (12, "https://weather.example.org/fr/1"),
        (13, "http://h#://com/en/"),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    got = {r.page_id: r for r in url_filter.judge(pages, url_filter.train(None, spark)).collect()}
    assert (got[1].host, got[1].path, got[1].rule, got[1].verdict) == ("www.example.com", "/en/7817", "example.com/en/7", "allow")
    assert [got[i].rule for i in (2, 3, 4, 5, 6, 7)] == ["com/en/", "com/en/", None, "example.net/de/8", "net/de/", "org/es/"]
    assert (got[8].host, got[9].path, got[10].host, got[10].path, got[13].host) == ("", "", "h", "", "h")
    assert got[11].verdict == "block" and got[12].verdict == "allow" and got[8].verdict == "allow"
    assert url_filter.judge(pages.where("false"), url_filter.train(None, spark)).count() == 0
    assert url_filter.train(spark.createDataFrame([("http://x.y/z", 1)], "url string, label int")).score(["x.y"], ["/z"])[0] > 0.9


def test_url_scores_against_brute_force(spark):
    """Scores are the logistic of the summed weights of the n-grams of host and path, one by one; very long urls, null ids and clashing columns."""
    model = url_filter.train(None, spark)

    def index(salt, s):
        out, b = set(), s.encode()
        for n in range(3, 6):
            for i in range(len(b) - n + 1):
                g = salt
                for x in b[i : i + n]:
                    g = (g * 0x100000001B3 + x) % (1 << 64)
                out.add(((g ^ g >> 31) * 0x9E3779B97F4A7C15 % (1 << 64)) >> 50)
        return out

    urls = ["https://poker.example.io/x", "http://Library.example.io/en/1?q#f", "no scheme", "://", None, "http://weather.io/" + "long/" * 30_000, "HTTP://POKER.IO"]
    rows = [(None if i == 1 else i, u, "h", "p", "v", 0.5) for i, u in enumerate(urls)]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string, path string, verdict string, score double")
    for r in url_filter.judge(pages, model).collect():
        ix = index(1, f"^{r.host}$") | index(2, f"^{r.path}$")
        z = sum(model.w[i] for i in ix) / max(len(ix), 1) ** 0.5 + model.bias
        assert r.score == pytest.approx(1 / (1 + np.exp(-z))) and (r.rule or r.verdict == ("block" if r.score >= 0.5 else "allow"))
    assert url_filter.judge(pages, model).count() == len(urls)


def test_held_out_urls():
    """Urls that were held out are told apart by their words; words that were held out are mostly allowed; ten words more or less change little."""
    import re

    def split(rows):
        at = [re.match(r"(?:.*?://([^/?#]*)([^?#]*))?", u) for u, _ in rows]
        return [m[1] or "" for m in at], [m[2] or "" for m in at], np.array([y for _, y in rows], float)

    table = url_filter.labelled_urls()
    h, p, y = split([r for i, r in enumerate(table) if i % 3])
    a, b, want = split([r for i, r in enumerate(table) if i % 3 == 0])
    assert np.mean((url_filter.fit(h, p, y).score(a, b) >= 0.5) == want) > 0.9
    some = url_filter.labelled_urls(url_filter.UNWANTED[10:], url_filter.ORDINARY[10:])
    whole, less = url_filter.fit(*split(table)), url_filter.fit(*split(some))
    a, b, _ = split([(f"https://{w}.example.com/en/{i}", 0) for i, w in enumerate(("granite", "kubernetes", "pillsbury", "essex", "coined", "lantern", "violin", "copper", "meadow", "planet"))])
    assert (whole.score(a, b) < 0.5).all() and (less.score(a, b) < 0.5).all()



# 10 lines


def distance(a, b):
    d = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, d[0] = d[0], i
        for j, y in enumerate(b, 1):
            last, d[j] = d[j], min(d[j] + 1, d[j - 1] + 1, last + (x != y))
    return d[-1]


def brute_lines(rows, least=5):
    every = [(i is None, i if i is not None else 0, n, line) for i, t, _ in rows for n, line in enumerate((t or "").split("\n")) if line.split()]
    out = []
    for i, t, _ in rows:
        if t is None:
            out.append((i, 0, 0, None))
            continue
        kept, lines = [], t.split("\n")
        for n, line in enumerate(lines):
            at, w = (i is None, i if i is not None else 0, n), line.split()
            gone = w and any((x[0], x[1], x[2]) < at and (x[3] == line or len(w) >= least <= len(x[3].split()) and line_dedup.close(w, x[3].split())) for x in every)
            kept += [] if gone else [line]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


def test_lines(spark, rows, none):
    line = "one two three four five six seven eight nine"
    more = [(70, f"{line}\n{line} ten\n\n  \nshort\n", "s"), (71, line.replace("five", "5") + "\nshort\nshorts", "s"), (72, line.replace("one ", "") + "\n" + line.replace("five", "five 5"), "s"), (73, "nine eight " + line, "s")]
    every = [r for r in rows if r[0] != 43] + more + [(74, f"{LONG}\n{LONG} more\n{line}", "s")]
    words = [f"u{i}" for i in range(9)]
    for n in range(1, 10):  # lines of 1 to 9 words: equal, one word changed, one left out, one more, two changed
        w = words[:n]
        every += [(80 + n, "\n".join(" ".join(x) for x in (w, w, [*w[:-1], "other"], w[1:], [*w, "more"], ["p", *w[1:-1], "q"])), "s")]
    df = documents(spark, every)
    assert collected(line_dedup.deduplicate(df)) == brute_lines(every)
    assert line_dedup.deduplicate(none).count() == 0
    assert line_dedup.dedup(df).columns == [*df.columns, "__n_lines", "__n_removed"]


def test_variants_of_close_lines_meet():
    rng = np.random.default_rng(7)
    for _ in range(300):
        a = [b"%d" % x for x in rng.integers(0, 4, rng.integers(1, 9))]
        b = [b"%d" % x for x in rng.integers(0, 4, rng.integers(1, 9))]
        assert line_dedup.close(a, b) == (distance(a, b) <= 1)
        va, vb = line_dedup.variants(a), line_dedup.variants(b)
        meet = va[-1] == vb[-1] or va[-1] in vb[:-1] or vb[-1] in va[:-1] or (len(va) == len(vb) and (va[:-1] == vb[:-1]).any())
        assert meet == line_dedup.close(a, b)


def test_repeated_rows_train_once_and_samples_are_bounded(spark):
    """One row repeated: a bounded sample, and its language is learnt all the same."""
    rows = [(1, "uno dos tres cuatro cinco seis siete", "es")] * 5000 + [(10 + i, f"one two three four five six seven number {i}", "en") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.train(df, max_sample=80)
    assert model.langs == ["en", "es"] and model.predict(["dos cuatro siete", "two four seven"])[0] == ["es", "en"]
    labels = spark.createDataFrame([(1, 1), (1, 1), (12, 0), (13, 0)], "doc_id long, quality int")
    assert len(quality.train(df, labels).tables) == len(quality.FEATURES)


def test_ambiguous_texts_are_flagged(spark):
    """Halves of two languages and random letters are flagged, whole texts of one language are not; a very long text and clashing columns too."""
    d = "/root/testdata/sf0.01"
    rows = [r for r in duckdb.sql(f"select text, lang from '{d}/documents.parquet' where length(text) > 400 and lang is not null order by doc_id limit 500").fetchall()]
    model = language_id.train(spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, text string, lang string"))
    by = {lang: [t for t, v in rows if v == lang] for lang in model.langs}
    first, second = sorted(by, key=lambda v: -len(by[v]))[:2]
    mixed = [a[:300] + " " + b[:300] for a, b in zip(by[first], by[second], strict=False)]
    rng = np.random.default_rng(5)
    junk = ["".join(rng.choice(list("qwxzkjvb gpf"), 300)) for _ in range(50)]
    assert np.mean(model.predict(mixed)[2]) > 0.7 and np.mean(model.predict(junk)[2]) > 0.8 and not any(model.predict([t for t, _ in rows])[2])
    long = " ".join(by[first])
    docs = spark.createDataFrame([(1, long, "x", 5), (2, mixed[0], "y", 6), (3, None, "z", 7)], "doc_id long, text string, lang_pred string, k int")
    assert [(r.doc_id, r.lang_pred, r.k) for r in language_id.filter_known(docs, model).collect()] == [(1, "x", 5)]
    assert [r.lang_pred for r in language_id.identify(docs, model).orderBy("doc_id").collect()][::2] == [first, "und"]


def test_nearby_windows_of_repeated_segments(spark):
    """Windows matched nearby are counted by document, whatever the number of blocks and however often rows repeat."""
    item = " ".join(f"w{i}" for i in range(14))
    docs = spark.createDataFrame([(1, item.replace("w3 w4", "w4 w3"))] * 2 + [(2, item)], "doc_id long, text string").coalesce(1)
    benchmark = spark.createDataFrame([("a", item)], "item_id string, text string")
    got = [sorted((r.doc_id, r.n_hit, r.n_near) for r in decontaminate.decontaminate(docs, benchmark, block=b).collect()) for b in (100, 2, 1)]
    assert got[0] == got[1] == got[2] and len(got[0]) == 3 and got[0][0][2] > 0
