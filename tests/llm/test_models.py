import random

import numpy as np
import zstandard

from tissueframe.llm import langid, quality


def texts(rng, words, n):
    return [" ".join(rng.choices(words, k=rng.randint(3, 60))) for _ in range(n)]


def test_languages_by_family(spark):
    rng = random.Random(9)
    vocab = {"en": "the of and thing with which should".split(), "de": "der und nicht über schön zwischen".split(), "fr": "le été où garçon être pour".split(), "es": "el niño años está para corazón".split(), "xx": "zorp qwik vrell".split()}
    rows = [(i, t, lang) for i, (lang, t) in enumerate((x, t) for x, w in vocab.items() for t in texts(rng, w, 80))]
    rows += [(9000, None, "en"), (9001, "123 !?", "en"), (9002, "", None), (9003, "Été " * 30_000, None), (9004, "Щ", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "1 AS Score")
    model = langid.fit(df.filter("doc_id % 4 > 0"))
    got = {r.doc_id: r for r in langid.predict(df, model).collect()}
    held = [(got[i].lang_pred, lang) for i, _, lang in rows if i < 9000 and i % 4 == 0]
    assert np.mean([a == b for a, b in held]) > 0.97
    assert [got[k].lang_pred for k in (9000, 9001, 9002, 9003)] == ["und", "und", "und", "fr"] and got[9004].lang_pred != "und"
    assert all(0 <= r.score <= 1 for r in got.values())
    assert set(model.families) == {"germanic", "romance", "other"}
    assert langid.fit(df.limit(0)) is None and {r.lang_pred for r in langid.predict(df, None).collect()} == {"und"}
    assert langid.predict(df.limit(0), model).count() == 0


def test_quality(spark):
    rng = random.Random(3)
    good, bad = [f"w{i}ord" for i in range(60)], [f"x{i}!!" for i in range(60)]
    rows = [(i, t) for i, t in enumerate(texts(rng, good, 150) + texts(rng, bad, 150))] + [(900, None), (901, ""), (902, "w1ord " * 60_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'k' AS predicted")
    labels = spark.createDataFrame([(i, int(i < 150), None) for i in range(300) if i % 3] + [(2, None, None), (None, 1, None)], "doc_id long, quality int, text string")
    model = quality.fit(df, labels.select("doc_id", "quality"))
    got = {r.doc_id: r for r in quality.predict(df, model).collect()}
    assert np.mean([got[i].predicted == (i < 150) for i in range(0, 300, 3)]) > 0.95
    assert got[900].score == got[901].score and 0 <= got[902].score <= 1
    assert quality.fit(df, labels.filter("quality = 1").select("doc_id", "quality")) is None
    assert {r.score for r in quality.predict(df, None).collect()} == {0.5} and quality.predict(df.limit(0), model).count() == 0


def test_quality_of_long_texts(spark):
    rng = random.Random(5)
    good, bad = ["".join(rng.choices("abcdefghij", k=7)) for _ in range(3000)], ["".join(rng.choices("klmnopqrst", k=7)) for _ in range(3000)]
    rows = [(i, t) for i, t in enumerate(texts(rng, good, 500) + texts(rng, bad, 500))]
    rows += [(k, " ".join(rng.choices(words, k=size // 8))) for k, words, size in ((2000, good, 300_000), (2001, good, 3_000_000), (3000, bad, 300_000), (3001, bad, 3_000_000))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 500)) for i in range(1000)], "doc_id long, quality int")
    got = {r.doc_id: r.score for r in quality.predict(df, quality.fit(df, labels)).filter("doc_id >= 2000").collect()}
    assert min(got[2000], got[2001]) > 0.9 and max(got[3000], got[3001]) < 0.1, got


def test_quality_fits_on_long_texts(spark):
    rng = random.Random(6)
    good, bad = [f"w{i}ord" for i in range(60)], [f"x{i}!!" for i in range(60)]
    df = spark.createDataFrame([(i, " ".join(rng.choices(good if i < 20 else bad, k=4500))) for i in range(40)], "doc_id long, text string")
    model = quality.fit(df, spark.createDataFrame([(i, int(i < 20)) for i in range(40)], "doc_id long, quality int"))
    assert model is not None and [r.predicted for r in quality.predict(df, model).orderBy("doc_id").collect()] == [1] * 20 + [0] * 20


def plain_language(model, text):
    """Language and score of one text, n-gram by n-gram."""
    if not any(map(str.isalpha, text)):
        return "und", 0.0
    raw = []
    for b in text.encode():
        raw.append(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32)
    for k in range(1, len(raw)):
        if raw[k - 1] == 0xC3 and 0x80 <= raw[k] <= 0x9E and raw[k] != 0x97:
            raw[k] += 0x20
    places = [(raw[k] | raw[k + 1] << 8) * 0x9E3779B1 % (1 << 32) >> 21 for k in range(len(raw) - 1)]
    places += [((raw[k] | raw[k + 1] << 8 | raw[k + 2] << 16) * 0x85EBCA77 % (1 << 32) >> 20) + langid.TWO for k in range(len(raw) - 2)]
    p = {}
    for k, (kind, a, b, bias, slope, shift) in enumerate(model.machines):
        margin = sum(model.weights[i, k] for i in places) / max(1, 2 * len(raw) - 3) + bias
        p[kind, a, b] = 1 / (1 + np.exp(-np.clip(slope * margin + shift, -40, 40)))
    names = list(model.families)
    family = [p.get(("family", f, ""), 1 - p["family", names[0], ""] if len(names) == 2 else 1.0) if len(names) > 1 else 1.0 for f in names]
    best = int(np.argmax(np.array(family) / sum(family)))
    own, scores = model.families[names[best]], {}
    for a in own:
        votes = [p["pair", a, b] if ("pair", a, b) in p else 1 - p["pair", b, a] for b in own if b != a]
        scores[a] = family[best] / sum(family) * (sum(votes) / (len(own) * (len(own) - 1) / 2) if votes else 1.0)
    top = max(scores.values())
    return min(a for a in own if scores[a] == top), top


def test_language_equals_a_plain_version_and_repeated_rows_agree(spark):
    rng = random.Random(19)
    vocab = {"en": "the of and thing with which should".split(), "de": "der und nicht über schön zwischen".split(), "nl": "het een zijn voor naar wordt".split(), "fr": "le été où garçon être pour".split(), "zz": "zorp qwik vrell".split()}
    rows = [(i, t, lang) for i, (lang, t) in enumerate((x, t) for x, w in vocab.items() for t in texts(rng, w, 40))]
    rows += [(9000 + i, t, None) for i, t in enumerate(["ÀÉ Ö", "a", "xy", "1 2", "ß", "der the le", "中文", "×÷ a×b"] * 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    # A hot row that a third of the table repeats counts once in the fit, and doesn't change it.
    model = langid.fit(df.filter("doc_id < 9000").unionByName(df.filter("doc_id = 3").crossJoin(spark.range(60)).drop("id")))
    got = [(r.doc_id, r.text, r.lang_pred, r.score) for r in langid.predict(df, model).collect()]
    for _, text, lang, score in got:
        want, value = plain_language(model, text)
        assert lang == want and abs(score - value) < 1e-9, (text, lang, want, score, value)
    assert len({(t, x, s) for _, t, x, s in got}) == len({t for _, t, _, _ in got})


def test_languages_without_letters_are_left_out(spark):
    rng = random.Random(3)
    rows = [(i, t, "en") for i, t in enumerate(texts(rng, "the of and".split(), 20))] + [(i, t, "fr") for i, t in enumerate(texts(rng, "le où".split(), 20), 30)]
    df = spark.createDataFrame([*rows, (90, "123", "de"), (91, "", "es"), (92, None, "nl")], "doc_id long, text string, lang string")
    assert langid.fit(df).languages == ["en", "fr"]
    assert langid.fit(df.filter("lang = 'en'")).languages == ["en"]
    assert langid.fit(df.filter("lang IN ('de', 'es', 'nl')")) is None and langid.fit(df.filter("lang = 'de'")) is None


def test_machines_reach_the_least_loss():
    """Dual coordinate descent against many plain subgradient steps on the same primal loss."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=(80, 6))
    y = np.where(x @ rng.normal(size=6) + 0.5 * rng.normal(size=80) > 0.2, 1.0, -1.0)
    cost = np.where(y > 0, 10 * 80 / (2 * (y > 0).sum()), 10 * 80 / (2 * (y < 0).sum()))
    loss = lambda w: 0.5 * w @ w + (cost * np.maximum(0, 1 - y * (x @ w[:-1] + w[-1]))).sum()
    w, best = np.zeros(7), np.inf
    for k in range(1, 40_000):
        bad = y * (x @ w[:-1] + w[-1]) < 1
        w -= (w - np.append((cost * y * bad) @ x, (cost * y * bad).sum())) / (k + 100)
        best = min(best, loss(w))
    assert loss(langid.linear_svm(x, y, rounds=2000)) <= best * 1.002


def test_scores_come_from_unseen_margins():
    rng = np.random.default_rng(7)
    x = np.concatenate([rng.normal(0.3, 1, (60, 40)), rng.normal(-0.3, 1, (60, 40))]).astype(np.float32)
    y = np.repeat([1.0, -1.0], 60)
    mixed = rng.permutation(120)
    w, bias, p, q = langid.train(x[mixed], y[mixed])
    seen = langid.platt((x @ w + bias).astype(np.float64), y)
    assert p < seen[0]  # flatter than a curve fitted on the machine's own rows


def test_quality_equals_a_plain_version(spark):
    rng = random.Random(23)
    good, bad = [f"w{i}ord" for i in range(60)], [f"x{i}!!" for i in range(60)]
    rows = [(i, t) for i, t in enumerate(texts(rng, good, 60) + texts(rng, bad, 60))] + [(900, None), (901, ""), (902, "w1ord x2!! " * 9000), (903, "w1ord"), (903, "w1ord"), (904, "ééé中")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 60)) for i in range(120)], "doc_id long, quality int")
    model = quality.fit(df, labels)
    kind = zstandard.DICT_TYPE_RAWCONTENT
    pack = lambda d: zstandard.ZstdCompressor(level=quality.LEVEL, write_checksum=False, write_content_size=False, **({"dict_data": zstandard.ZstdCompressionDict(d, dict_type=kind)} if d else {})).compress
    sizes = [pack(model.bad), pack(model.good), pack(None)]
    for r in quality.predict(df, model).collect():
        raw = (r.text or "").encode()
        n = max(1, -(-len(raw) // quality.PIECE))
        parts = [raw[len(raw) * i // n : len(raw) * (i + 1) // n] for i in range(n)] if raw else []
        a, b, c = (sum(len(f(x)) for x in parts) for f in sizes)
        want = 1 / (1 + np.exp(-(model.a * ((a - b) / c if parts else 0.0) + model.b)))
        assert abs(r.score - want) < 1e-9 and r.predicted == (r.score >= 0.5)


def test_dictionary_is_filled_evenly():
    texts_ = [(3, b"a" * 10), (500, b"b" * 1000), (-7, b"c" * 50), (1 << 40, b"d" * 1000)]
    out = quality.dictionary(texts_, 400)
    assert {c: out.count(c) for c in b"abcd"} == {97: 10, 98: 170, 99: 50, 100: 170}
    assert quality.dictionary(texts_, 10_000) == b"".join(t for _, t in texts_) and quality.dictionary([], 5) == b""
    long = bytes(range(100))
    assert quality.dictionary([(205, long), (-1, long)], 20) == long[23:33] + long[90:100]


def test_quality_takes_one_text_a_key(spark):
    """A labelled key that very many rows share brings one text to the fit."""
    rows = [(i, f"good words number {i} here" if i < 20 else f"x!! {i} ?? {i * i}") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    hot = df.unionByName(spark.range(3000).selectExpr("1L AS doc_id", "concat('copy ', id) AS text"))
    labels = spark.createDataFrame([(i, int(i < 20)) for i in range(40)], "doc_id long, quality int")
    model = quality.fit(hot, labels)
    assert len(model.good) < 1500 and model.good.count(b"copy") <= 1


def test_no_labelled_language_is_lost(spark):
    """Ten languages of many texts and six of three: all are learned, and their own texts are told right."""
    rng = random.Random(77)
    many, few = "en de nl fr es it pl cs sv da".split(), "fi he hi hu tr xx".split()
    words = {x: ["".join(rng.choices("abcdefghijklmnopqrstuvwxyzäöüéñł", k=rng.randint(2, 7))) for _ in range(25)] for x in many + few}
    rows = [(x, " ".join(rng.choices(words[x], k=30))) for x in many for _ in range(120)] + [(x, " ".join(rng.choices(words[x], k=30))) for x in few for _ in range(3)]
    df = spark.createDataFrame([(i, t, x) for i, (x, t) in enumerate(rows)], "doc_id long, text string, lang string")
    model = langid.fit(df, per_machine=300)
    assert model.languages == sorted(many + few)
    got = [(r.lang, r.lang_pred) for r in langid.predict(df, model).collect()]
    assert sum(a == b for a, b in got) > 0.97 * len(got)
    assert sum(a == b for a, b in got if a in few) >= 15


def test_texts_of_machines_are_bounded_and_dealt_by_class():
    counts = {f"x{i}": 600 for i in range(100)} | {"fi": 3, "en": 600}
    plan = langid.allotted(counts, 1500, 200_000)
    todo = langid.machines(sorted(counts))
    of = {k: {} for k in range(len(todo))}
    for label, k, share in plan:
        of[k][label] = share * counts[label]
    assert sum(sum(v.values()) for v in of.values()) < 500_000
    for k, (kind, a, b) in enumerate(todo):
        assert set(of[k]) == ({a, b} if kind == "pair" else set(counts)) and all(v > 0 for v in of[k].values())
        if kind == "family":
            assert of[k]["fi"] == 3 and sum(of[k].values()) <= 1501
