"""Table functions against the DataFrame forms, over receipts and noise, and the DataFrame forms against stated answers."""

import random
from datetime import date

import pytest
from pyspark.sql import functions as F

from tallyloom import tables
from tallyloom.operators import names, quality

AS_OF = "2024-05-20"
SLIPS = [
    "BAUHAUS & CO KB\nGamla Nynasvagen 600\nS-142 51 Skogas\nORG.NR: 969630-6944\n2 GRALUMPPAPP    198,00",
    "TELEFONNUMMER: 077-520 00 00\nVISA Contactless  ************8618-0\nTERM: 14314539-352298/ 30559082\nKvittonr: 151322",
    "Org.nr S56012-5790", "Org.nr SS6012-5790", "Momsreg.nr 165560125790", "Kundnr 556297-3320 ... ORG NR 556012-5790", "5562973320", "3062973320",
    "x_556012-5790", "a 556012–5790 och 556012.5790", "ORG NR 5560l2 5790", "www.bauhaus.se\ninfo@ica-kvantum.se\nfacebook.com", "Hotellgruppen.se  Byggsverige . com", "kl 14:22\nDatum 2024-05-19 14:22:10\n19/5-24 9:05",
    "Bäst före 2030-01-01\n1 maj 2024\n15 mars\n31.02.2024\n12-13-2024", "Dat 01.02.24\n01.02.24 10:11\n2025-01-01", "", "   ", None,
]


@pytest.fixture(scope="module")
def texts(spark):
    rng = random.Random(7)
    pieces = ["556012-5790", "5560I2-5790", "969630 6944", " ", "\n", "org.nr ", "2024-05-19", "19/5-24", " 12:30", "3 maj", "Datum ", "Garanti ", "ica.se", "www.x-y.nu", "a_", "-", "0", "l", "Å", "shop.com", "SE5560125790 01", "\r\n", "T"]
    noise = ["".join(rng.choice(pieces) for _ in range(rng.randrange(1, 25))) for _ in range(150)]
    df = spark.createDataFrame(list(enumerate(SLIPS + noise)), "id long, text string")
    df.createOrReplaceTempView("slips")
    tables.register(spark)
    return df


def rows(df, digits=6):
    return sorted((tuple(round(x, digits) if isinstance(x, float) else x for x in r) for r in df.collect()), key=repr)


def test_numbers_and_their_places(spark, texts):
    got = rows(spark.sql("SELECT t.id, n.digits, n.confidence, n.repaired, n.labelled, n.at FROM slips t, LATERAL tl_org_numbers(t.text) n"))
    assert got == rows(names.org_numbers(texts).select("id", "digits", "confidence", "repaired", "labelled", "at"))
    by = {i: [(d, at) for j, d, _, _, _, at in got if j == i] for i in range(len(SLIPS))}
    assert by[0] == [("9696306944", SLIPS[0].index("969630"))] and by[1] == [] and by[3] == []
    assert by[2] == [("5560125790", 7)] and by[4] == [("5560125790", 11)]
    assert dict(by[5]) == {"5562973320": 7, "5560125790": SLIPS[5].index("556012")}


def test_dates_and_their_lines(spark, texts):
    got = rows(spark.sql(f"SELECT t.id, n.value, n.confidence, n.line FROM slips t, LATERAL tl_dates(t.text, DATE'{AS_OF}') n"))
    assert got == rows(names.purchase_dates(texts, AS_OF).select("id", "value", "confidence", "line"))
    assert ("2024-05-19T14:22:10", 1) in [(v, k) for i, v, _, k in got if i == 13]


def test_domains_and_their_lines(spark, texts):
    got = rows(spark.sql("SELECT t.id, lower(n.name), n.confidence, n.line FROM slips t, LATERAL tl_domains(t.text) n").where(F.col("id") < len(SLIPS)))
    some = names.name_candidates(texts.where(F.col("id") < len(SLIPS))).where("source = 'domain'")
    assert set(got) >= set(rows(some.select("id", F.lower("query"), "confidence", "line")))
    assert [r[1] for r in got if r[0] == 11] == ["bauhaus", "ica kvantum"]


def test_a_table_argument_gathers_the_pieces_of_a_receipt(spark, texts):
    pieces = texts.select((F.col("id") % 40).alias("id"), "text")
    pieces.createOrReplaceTempView("pieces")
    got = spark.sql(f"SELECT id, texts, digits, value, name FROM tl_scan(TABLE(pieces) PARTITION BY (id), DATE'{AS_OF}')").collect()
    by = {}
    for r in pieces.collect():
        by.setdefault(r["id"], []).append(r["text"])
    day = date.fromisoformat(AS_OF)

    def best(found):
        return min(((-c, x) for f in found for x, c, *_ in f), default=(0, None))[1]

    want = {(str(i), len(ts), best(map(tables.org_numbers, ts)), best(tables.dates(t, day) for t in ts), best(map(tables.domains, ts))) for i, ts in by.items()}
    assert set(map(tuple, got)) == want


def test_lines_and_letters_by_their_shape(spark):
    lines = {"*** ICA Nära ***": "ICA Nära", "B A U H A U S": "BAUHAUS", "A B Bygg": "A B Bygg", "H & M": "H & M", "  ~=Hem  och\tTrädgård=~ ": "Hem och Trädgård", "": "", "I C A Maxi C o o p": "ICA Maxi Coop"}
    df = spark.createDataFrame([(k,) for k in lines], "t string")
    assert {r[0]: r[1] for r in df.select("t", names.tidy(F.col("t"))).collect()} == lines
    asked = {"Bauhaus": True, "B4uhaus": False, "BaUhaus": False, "Clas Ohlson": True, "Krrrdst": False, "Hem 24": False, "ab": False, "Öl & Åäö": False, "Zzz": False, "Jula": True, "Rusta Ab": True}
    df = spark.createDataFrame([(k,) for k in asked], "t string")
    assert {r[0]: r[1] for r in df.select("t", names.searchable(F.col("t"))).collect()} == asked
    kinds = {"Pant 1 kr": "deposit", "Pantburk": "product", "Kampanj läsk": "discount", "Rea byxor": "discount", "Realistisk bok": "product", "PRISNEDSÄTTNING": "discount", "returpant": "product", "Mjölk": "product"}
    df = spark.createDataFrame([(k,) for k in kinds], "t string")
    assert {r[0]: r[1] for r in df.select("t", quality.line_class(F.col("t"), F.lit(1.0))).collect()} == kinds
