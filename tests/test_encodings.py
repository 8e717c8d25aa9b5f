import os

import pandas as pd
import pytest
from pyspark.sql import functions as F

from newsflow.sources.encodings import detector, encoded, profile

SF = "/root/testdata/sf0.01"
LEARNT = [
    "Über die Brücke führt ein schmaler Weg, größer als früher. Die Straße heißt schöne Aussicht.",
    "Le café est fermé depuis hier, où êtes-vous allés? Ça été très drôle, à la forêt près du château.",
    "Сегодня утром в городе открыли новый мост, и жители смогли наконец перейти через реку.",
    "Η πόλη άνοιξε σήμερα το πρωί μια νέα γέφυρα και οι κάτοικοι πέρασαν το ποτάμι.",
    "Zażółć gęślą jaźń, a potem wróć do domu przez łąkę; świeże mleko stoi już na stole.",
]
OTHERS = {"cp1252": "Früh hören wir schöne Größen", "cp850": "élève très âgée à la fenêtre", "mac_roman": "Près de la forêt, où êtes-vous né?", "cp1251": "Город открыл мост утром", "koi8_r": "Город открыл мост утром", "cp866": "новый город и река", "cp1253": "η νέα πόλη και το ποτάμι", "cp1250": "gęś wróć już świeże łąkę"}


def test_code_pages_of_other_texts(spark):
    detect = detector(profile(spark.createDataFrame([(t,) for t in LEARNT] + [(None,), ("",)], "text string"), "text"))
    rows = [(page, bytearray(text.encode(page)), text) for page, text in OTHERS.items()]
    got = spark.createDataFrame(rows, "page string, raw binary, text string").select("page", "text", detect(F.col("raw")).alias("d")).collect()
    assert {r["page"]: (r["d"]["code_page"], r["d"]["text"]) for r in got} == {p: (p, t) for p, t in OTHERS.items()}


def test_what_needs_no_profile(spark):
    none = spark.createDataFrame([], "code_page string, pair int, n long")
    detect = detector(none)
    rows = [(0, None, None), (1, b"", "x"), (2, b"plain", "utf-16"), (3, "Größe".encode(), "latin-1"), (4, "Größe".encode("utf-8-sig"), None), (5, "Größe".encode("utf-16"), None), (6, "Größe".encode("utf-16-le"), None), (7, "Größe!".encode("utf-16-be"), None), (8, "Größe".encode("cp850"), "cp850"), (9, "Größe".encode("latin-1"), None), (10, "Größe".encode("latin-1"), "no such page"), (11, b"a\0b", None), (12, ("é" * 300_000).encode("latin-1"), "latin-1")]
    got = spark.createDataFrame([(i, bytearray(r) if r is not None else None, d) for i, r, d in rows], "id int, raw binary, declared string").select("id", detect(F.col("raw"), F.col("declared")).alias("d")).collect()
    found = {r["id"]: tuple(r["d"]) if r["d"] else None for r in got}
    assert found[0] in (None, (None, None)) and found[1] == ("utf-8", "") and found[2] == ("utf-8", "plain")
    assert all(found[i][1].rstrip("!") == "Größe" for i in range(3, 11)) and found[8][0] == "cp850" and found[10][0] == "latin-1"
    assert [found[i][0] for i in (5, 6, 7)] == ["utf-16-le", "utf-16-le", "utf-16-be"] and found[11] == ("utf-8", "a\0b") and found[12][1] == "é" * 300_000


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_recall_on_pages_by_a_profile_of_documents(spark):
    pages = ["cp1252", "cp850", "mac_roman"]
    detect = detector(profile(spark.read.parquet(f"{SF}/documents.parquet"), "text", pages), pages)

    @F.pandas_udf("binary")
    def raw(html: pd.Series, page: pd.Series) -> pd.Series:
        return pd.Series([encoded(t, p) for t, p in zip(html, page)], dtype=object)

    each = spark.read.parquet(f"{SF}/pages.parquet").select("html", F.explode(F.array(*map(F.lit, pages))).alias("page"))
    rows = each.select("html", raw("html", "page").alias("raw")).where("raw is not null AND NOT is_valid_utf8(CAST(raw AS STRING))")
    right, n = rows.select((detect(F.col("raw"))["text"] == F.col("html")).cast("int").alias("ok")).agg(F.sum("ok"), F.count("*")).first()
    assert n > 300 and right >= 0.99 * n, (right, n)
