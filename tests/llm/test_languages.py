import pytest
from pyspark.sql import functions as F

from loamdex.llm import languages as L


@pytest.fixture(scope="module")
def fitted(spark, sf):
    big = sf.replace("0.001", "0.01")
    docs, codes = spark.read.parquet(f"{big}/documents.parquet"), spark.read.parquet(f"{big}/lang_codes.parquet")
    return docs, codes, L.train(docs, codes)


def texts(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, confidence double")


def test_sentences(spark):
    t = "# Heading here.\nFirst one is `x.y` fine. And `a_b` second!\n\n```\ncode is here.\n```\n* Item goes\non further.\n> 引用です。次です。\nNo end\nWe call foo_bar(x) and a/b.py.\r\n\r\n    indented code.\n"
    got = texts(spark, [(1, t, None, 0.0), (2, None, None, 0.0), (3, "", None, 0.0)]).orderBy("doc_id").select(L.sentences(F.col("text"))).collect()
    first = [" ".join(x.split()) for x in got[0][0]]
    assert first == ["First one is fine.", "And second!", "Item goes on further.", "引用です。", "次です。", "We call (x) and ."]
    assert got[1][0] == got[2][0] == []


MARKS = r'''Copy the files in src/* first.
It accepts */* here.
It runs at */5 * * * * daily.
See `/*` and `"""` there.
A """ opens it.
/* Never closed.
"""Not closed.
/* Every file of the root, and then at */5 daily.
From a/* to b/*.py it goes, and */ ends.'''


@pytest.mark.parametrize("text,n", [*((line + " ", 1) for line in MARKS.split("\n")), ("/* gone.\n gone too. */\n", 0), ('  """ gone.\ngone. """\n', 0), ("```\n/* open.\n```\n", 0)])
def test_marks_in_a_line_are_no_listing(spark, text, n):
    got = texts(spark, [(1, f"{text}Danach wird alles neu gebaut. Das dauert lange.", None, 0.0)]).select(L.sentences(F.col("text"))).first()[0]
    assert [" ".join(x.split()) for x in got][n:] == ["Danach wird alles neu gebaut.", "Das dauert lange."]


@pytest.mark.parametrize("label,want", [("en-US", "en"), (" Deutsch ", "de"), ("fre", "fr"), ("pt_BR", "pt"), ("Español (México)", "es"), ("日本語", "ja"), ("Brazilian Portuguese", "pt"), ("und", None), ("", None), (None, None), ("python", None), ("sv", None)])
def test_labels(spark, fitted, label, want):
    names = L.label_names(fitted[1])
    assert spark.createDataFrame([(label,)], "l string").select(L.named_language(F.col("l"), names)).first()[0] == want


def test_held_out_accuracy(spark, fitted, sf):
    """Samples of the languages, sentence by sentence, against their own label."""
    docs, codes, p = fitted
    parts = codes.select("lang", F.explode(L.sentences(F.col("sample"))).alias("s")).collect()
    texts_ = [L._clean(r["s"]) for r in parts]
    near, _ = L._best(p.distances(texts_))
    assert sum(p.langs[i] == r["lang"] for i, r in zip(near, parts)) / len(parts) > 0.97


def test_mixed_documents(spark, fitted):
    docs, codes, p = fitted
    rows = [
        (1, "The old cache keeps a copy of the rows in memory. Der alte Cache behält eine Kopie der Zeilen im Speicher.", "English", 0.0),
        (2, "Ce module ne dépend plus de la file d'attente.", "fr-CA", 0.0), (3, "LA COLA DE ESPERA DEVUELVE UNA LISTA VACÍA.", None, 0.0), (4, None, "en", 0.0), (5, "   ", None, 0.0), (6, "def f():\n    return 1", "xx", 0.0),
        (7, "Старый кэш следит за блокировками. " * 300, "ru", 0.0),
    ]
    df = texts(spark, rows)
    got = {}
    for r in L.label_documents(df, codes, p).collect():
        got.setdefault(r["doc_id"], {})[r["lang"]] = (r["given"], r["share"])
    assert set(got[1]) == {"en", "de"} and got[1]["de"][0] == "en" and abs(sum(s for _, s in got[1].values()) - 1) < 1e-9
    assert set(got[2]) == {"fr"} and set(got[3]) == {"es"} and set(got[7]) == {"ru"}
    assert all(set(got[i]) == {None} for i in (4, 5, 6))
    seg = L.segments(df, p).where("doc_id = 1").orderBy("segment_no").collect()
    assert [s["lang"] for s in seg] == ["en", "de"] and all(0 <= s["confidence"] <= 1 for s in seg)
    assert L.segments(df.limit(0), p).count() == 0


def test_distance_against_brute_force(fitted):
    p = fitted[2]
    text = L._clean("the cache and the theme of the rows")
    from collections import Counter

    count = Counter(int(h) for h in L.grams([text])[1])
    at = {int(k): i for i, k in enumerate(p.keys)}
    known = sorted((g for g in count if g in at), key=lambda g: (-count[g], at[g]))[: L.OWN]
    for i, lang in enumerate(p.langs):
        far = [abs(int(p.rank[i, at[g]]) - r) if p.rank[i, at[g]] < L.PROFILE else L.PROFILE for r, g in enumerate(known)]
        assert p.distances([text])[0, i] == pytest.approx(sum(far) / len(far) / L.PROFILE)


def test_texts_without_a_stop_have_a_language(spark, fitted):
    texts = ["Fix the race in the cache loader and keep the old entries until the next reload", "Der Zwischenspeicher wird beim nächsten Start neu aufgebaut", "```\nlisting only\n```", None, "", "12 34", "ok", "It is whole by now. and this is not"]
    docs = spark.createDataFrame([(i, t, None) for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    got = {r["doc_id"]: (r["lang"], r["n_sentences"]) for r in L.segments(docs, fitted[2]).collect()}
    assert got[0] == ("en", 0) and got[1] == ("de", 0) and got[7] == ("en", 1)
    assert all(got[i] == (None, 0) for i in (2, 3, 4, 5, 6))


def test_too_many_ngrams_are_an_error():
    import numpy as np

    n = 1 << L.KEY_BITS
    with pytest.raises(ValueError):
        L.Profiles({f"l{i}": np.arange(i * L.PROFILE, (i + 1) * L.PROFILE, dtype=np.uint64) for i in range(n // L.PROFILE + 1)})
