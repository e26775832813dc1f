import base64
import random

import pytest
from pyspark.sql import functions as F

from factloom.llm import language, mixing, tokenize

TEXTS = [None, "", " ", "\n\n  x", "The quick brown fox, it's 12345!", "Không có gì đâu", "ﬁ ﬂ ½ 👨‍💻 \u200b\ufeff", "a" * 5000, "đ" * 400, "<|endoftext|> [MASK]", "don't  stop\t\r\n", "x\x00y", "中文测试" * 50, "the " * 3000]


@pytest.fixture(scope="module")
def vocabulary():
    import os

    path = tokenize.vocabulary()
    if not os.path.exists(path):
        pytest.skip("no vocabulary files here")
    return path


def test_ids_against_the_library(vocabulary):
    tiktoken = pytest.importorskip("tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(vocabulary, "rb"))}
    ref = tiktoken.Encoding("own", pat_str=tokenize.PATTERN, mergeable_ranks=ranks, special_tokens={})
    e = tokenize.Encoder(vocabulary)
    rnd = random.Random(5)
    texts = TEXTS + ["".join(rnd.choice("abc đé'\n 19.,{中") for _ in range(rnd.randrange(60))) for _ in range(300)]
    texts += ["".join(rnd.choice("etaoinshrdlu") for _ in range(1500)), "ab" * 400 + "a" * 301, "xyzzy" * 90]
    got = e.encode(texts)
    assert got == [ref.encode_ordinary(t) if t else [] for t in texts]
    assert [e.decode(i) for i in got] == [t or "" for t in texts]


def test_memory_limit_changes_nothing(vocabulary, monkeypatch):
    e = tokenize.Encoder(vocabulary)
    want = e.encode(TEXTS)
    monkeypatch.setattr(tokenize, "REMEMBERED", 5)
    monkeypatch.setattr(tokenize, "ROWS", 7)
    small = tokenize.Encoder(vocabulary)
    assert [small.encode([t])[0] for t in TEXTS] == want


def test_encode_table(spark, vocabulary):
    df = spark.createDataFrame([(i, t, "s") for i, t in enumerate(TEXTS)], "doc_id bigint, text string, ids string")
    e = tokenize.Encoder(vocabulary)
    assert {r.doc_id: r.ids for r in tokenize.encode(df).collect()} == dict(enumerate(e.encode(TEXTS)))
    assert {r.doc_id: r.n_tokens for r in tokenize.sizes(df, "doc_id", "text", []).collect()} == {i: len(x) for i, x in enumerate(e.encode(TEXTS))}
    assert tokenize.encode(df.limit(0)).count() == 0


def test_plan_limits_total_by_the_scarcest_source():
    p = mixing.plan([("a", 1000), ("b", 100), (None, 5)], [("a", 0.5, 1), ("b", 0.25, 3), ("c", 0.25, 2), ("d", -1.0, None)])
    assert p["b"]["budget"] == 300 and p["b"]["whole"] == 3 and p["b"]["rest"] == 0
    assert p["a"]["budget"] == 600 and p["a"]["whole"] == 0 and p["a"]["rest"] == 600 and p["c"]["budget"] == 0 and p["d"]["budget"] == 0


def sized(spark, n=4000, seed=1):
    rnd = random.Random(seed)
    rows = [(i, ["big", "mid", "rare", None, "other"][min(int(rnd.expovariate(1.2)), 4)], rnd.choice([0, None, 3, 20, 20, 90, 400])) for i in range(n)]
    return rows, spark.createDataFrame(rows, "doc_id bigint, source string, n_tokens bigint")


def test_mixture_meets_shares_and_repeats(spark):
    rows, df = sized(spark)
    targets = spark.createDataFrame([("big", 0.4, 1), ("mid", 0.3, 2), ("rare", 0.25, 4), ("none", 0.05, 5)], "source string, target_share double, max_repeats int")
    sel, p = mixing.select(df, targets)
    got = sel.collect()
    assert len({r.doc_id for r in got}) == len(got)
    total = sum(r.n_tokens * r.copies for r in got if r.n_tokens)
    for s, share, most in (("big", 0.4, 1), ("mid", 0.3, 2), ("rare", 0.25, 4)):
        mine = [r for r in got if r.source == s]
        assert max(r.copies for r in mine) <= most
        assert abs(sum((r.n_tokens or 0) * r.copies for r in mine) / total - share / 0.95) < 0.01
        assert 0 <= p[s]["budget"] - sum((r.n_tokens or 0) * r.copies for r in mine) <= 400
    report = {r.source: r for r in mixing.shares(sel, p).collect()}
    assert report["none"].taken == 0 and report["none"].gap == -0.05 and abs(sum(r.actual_share for r in report.values()) - 1) < 1e-3
    assert sorted(r.doc_id for r in got) == sorted(r.doc_id for r in mixing.select(df.repartition(7), targets)[0].collect())


def test_sample_follows_pareto_order(spark):
    rows, df = sized(spark, 800, 3)
    targets = spark.createDataFrame([("big", 0.5, 1), ("mid", 0.5, 1)], "source string, target_share double, max_repeats int")
    sel, p = mixing.select(df, targets)
    s = "big" if p["big"]["rest"] > 0 and not p["big"]["whole"] else "mid"
    own = [(i, n) for i, src, n in rows if src == s and n]
    c = p[s]["rest"] / sum(n * n for _, n in own)
    assert max(c * n for _, n in own) < 1
    u = {r.doc_id: r.u for r in df.select("doc_id", ((F.pmod(F.xxhash64("doc_id", F.lit(0)), F.lit(1 << 52)) + 0.5) / F.lit(float(1 << 52))).alias("u")).collect()}
    order = sorted(own, key=lambda x: (u[x[0]] / (1 - u[x[0]])) / (c * x[1] / (1 - c * x[1])))
    want, left = set(), p[s]["rest"]
    for i, n in order:
        left -= n
        if left < 0:
            break
        want.add(i)
    assert {r.doc_id for r in sel.collect() if r.source == s} == want


def test_mixture_of_nothing(spark):
    _, df = sized(spark, 10)
    targets = spark.createDataFrame([("zzz", 1.0, 2), (None, 0.5, 1)], "source string, target_share double, max_repeats int")
    sel, p = mixing.select(df, targets)
    assert sel.count() == 0 and mixing.shares(sel, p).count() == 1


SENTENCES = {
    "en": ["The {} report was read again by the team on the server.", "We could not find any reason for the {} error in the log.", "Please check the {} value before you merge the branch."],
    "fr": ["Le rapport {} a été relu par l'équipe sur le serveur.", "Nous n'avons trouvé aucune raison pour l'erreur {} dans le journal.", "Merci de vérifier la valeur {} avant de fusionner la branche."],
    "de": ["Der Bericht {} wurde vom Team auf dem Server erneut gelesen.", "Wir konnten keinen Grund für den Fehler {} im Protokoll finden.", "Bitte den Wert {} vor dem Zusammenführen des Zweigs prüfen."],
    "es": ["El informe {} fue leído otra vez por el equipo en el servidor.", "No encontramos ninguna razón para el error {} en el registro.", "Por favor, compruebe el valor {} antes de juntar la rama."],
    "pt": ["O relatório {} foi lido outra vez pela equipe no servidor.", "Não encontramos nenhum motivo para o erro {} no registro.", "Por favor, verifique o valor {} antes de juntar o ramo."],
    "vi": ["Báo cáo {} đã được nhóm đọc lại trên máy chủ.", "Chúng tôi không tìm thấy lý do nào cho lỗi {} trong nhật ký.", "Hãy kiểm tra giá trị {} trước khi gộp nhánh này."],
}
WORDS = {"en": "first last empty broken".split(), "fr": "premier dernier vide cassé".split(), "de": "erste letzte leere kaputte".split(), "es": "primero último vacío roto".split(), "pt": "primeiro final vazio quebrado".split(), "vi": "đầu cuối trống hỏng".split()}


def corpus(seed, n):
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        lang = rnd.choice(list(SENTENCES))
        say = lambda k: rnd.choice(SENTENCES[k]).format(rnd.choice(WORDS[k]))
        text = " ".join(say(lang) for _ in range(rnd.randrange(1, 5)))
        held = {lang}
        if rnd.random() < 0.15:
            other = rnd.choice([k for k in SENTENCES if k != lang])
            text += "\n\n" + say(other)
            held.add(other)
        if rnd.random() < 0.3:
            text += " «" + say(rnd.choice(list(SENTENCES))) + "» `x()`"
        if rnd.random() < 0.2:
            text = text.upper()
        label = lang if rnd.random() < 0.85 else rnd.choice([None, "und", "", *SENTENCES])
        out.append((i, text, label, held))
    return out


def test_held_out_accuracy(spark):
    train, test = corpus(1, 1500), corpus(2, 600)
    schema = "doc_id bigint, text string, lang string"
    model = language.fit(spark.createDataFrame([r[:3] for r in train], schema))
    docs = spark.createDataFrame([r[:3] for r in test], schema)
    got = {r.doc_id: r for r in language.documents(docs, language.segments(docs, model)).collect()}
    right = sum(set(got[i].langs or ()) == held for i, _, _, held in test)
    assert right / len(test) >= 0.98
    for i, _, label, held in test[:200]:
        if set(got[i].langs or ()) == held:
            assert got[i].is_case == (held != {label})


def test_odd_texts_hold_no_language(spark):
    model = language.fit(spark.createDataFrame([r[:3] for r in corpus(1, 600)], "doc_id bigint, text string, lang string"))
    odd = [None, "", "  ", "```\nThe first report was read again by the team.\n```", "src/a.php:1:2 HIGH", "«The first report was read again by the team.»", "x" * 50_000, "中文测试。", "\ufeff\u200b", "$a = b();"]
    assert all(not language.segments_of(model, t) for t in odd)
    long = "The first report was read again by the team on the server. " * 2000
    (seg,) = language.segments_of(model, long)
    assert seg[2] == "en" and seg[3] == 2000


def test_labels():
    assert [language.named(x) for x in ("EN", "en_GB", "pt-BR", "Vietnamese", "vie", " fr ", "und", "unknown", None, "", "it")] == ["en", "en", "pt", "vi", "vi", "fr", None, None, None, None, None]


def test_label_column_agrees(spark):
    labels = ["EN", "en_GB", "pt-BR", "Vietnamese", " fr ", "und", None, "", "it"]
    df = spark.createDataFrame([(x,) for x in labels], "l string").select(language.label_column(F.col("l")).alias("x"))
    assert [r.x for r in df.collect()] == [language.named(x) for x in labels]
