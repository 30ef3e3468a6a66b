import random

from docketry.llm.scans import Reader, furniture_of, line_defects, mask, repaired_paragraphs

WORDS = "the agreement permits disposal of coupe without written consent under appraisal provision either side may demand an umpire when parties cannot agree on amount loss valuation report arrived payment re-inspection during mortgage servicer".split()
LEXICON = {w: 500 for w in WORDS}


def reader():
    return Reader(LEXICON)


def test_words():
    r = reader()
    for bad in ("agreernent", "wr!tten", "consenf", "d1sposal", "pr0vision", "umpirc", "th�", "(cid:82)greement", "vvhen", "thе", "$l,491"):
        assert r.wrong(bad), bad
    for good in ("agreement", "Umpire,", "$1,491.00", "06PUE", "re-inspection", "Whiterridge", "m²", "", "-", "|", "3rd", "café"):
        assert not r.wrong(good), good
    assert r.repair_token("Agreernent,") == "Agreement,"


def test_lines():
    text = "Umbral Assurance Records\nThe agreement permits dispo-\nsal of the coupe during the re-\ninspection without writ-\nten consenf. Page 35 is missing.\n\n- 3 -"
    got = set(reader().defects(text, None, True, frozenset([mask("Umbral Assurance Records")])))
    assert got == {(1, "running"), (2, "hyphen"), (4, "hyphen"), (5, "misread"), (7, "running")}
    assert (1, "hyphen") in reader().defects("either side may demand an umpi-\n2", "3\nre when the parties", True)
    assert reader().defects("", None, True) == [] and reader().defects("\n\n", None, False) == []
    assert ("misread" in {d for _, d in reader().defects("the val-\nuafion report", None, True)}) and (2, "misread") in reader().defects("the val-\nuafion report", None, True)


def test_paragraphs():
    text = "The agreernent permits dispo-\nsal of the coupe.\n\nEither side may\ndemand an umpire.\n7"
    assert reader().paragraphs(text, True) == ["The agreement permits disposal of the coupe.", "Either side may demand an umpire."]
    assert reader().paragraphs("", True) == []


def test_tables(spark):
    body = "the agreement permits disposal of the coupe without written consent\nunder the appraisal provision either side may demand an umpire"
    pages = spark.createDataFrame([(i, i // 3, i % 3 + 1, f"Holmgate Records {i}\n{body}\n{body.upper() if i == 4 else ''}\n{'the pay-' if i == 0 else 'end'}" if i != 7 else "") for i in range(12)] + [(50, 9, 1, None)], "page_id bigint, extraction_id bigint, page_number int, text string")
    results = spark.createDataFrame([(1, "tesseract@5", None), (2, "tesseract@5", "a tiny text"), (3, "stdlib-email", "payment payment payment payment ment")], "extraction_id bigint, method string, text string")
    known = {r.doc: r for r in furniture_of(pages, results).collect()}
    assert all(mask("Holmgate Records 5") in known[i].seen for i in range(4)) and mask("Holmgate Records 5") in known[0].own
    got = {(r.src, r.row_id, r.line_no, r.defect) for r in line_defects(pages, results).collect()}
    assert all(("page_results", i, 1, "running") in got for i in range(12) if i != 7)
    assert {(r.row_id, r.paragraph) for r in repaired_paragraphs(pages, results).collect() if r.src == 'extraction_results'} == {(2, "a tiny text")} and line_defects(pages.limit(0), results.limit(0)).count() == 0


def test_lost_letters_and_misread_numbers():
    r = reader()
    for bad, good in (
        ("agree�ent,", "agreement,"), ("(cid:82)greement", "agreement"), ("Th(cid:99)", "The"), ("dispos��l", "disposal"), ("U(cid:7)(cid:8)ire", "Umpire"), ("re-insp�ction.", "re-inspection."), ("valuati�n/apprai�al", "valuation/appraisal"),
        ("AGREEM�NT", "AGREEMENT"), ("�greernent", "agreement"), ("$l,491", "$1,491"), ("$1,S9O.0l", "$1,590.01"), ("2O19", "2019"), ("$1,�91", "$1,�91"), ("�", "�"), ("zq�xv", "zq�xv"),
    ):
        assert r.repair_token(bad) == good, bad
    assert r.paragraphs("The valu(cid:4)tion report arr�-\nved when the mort(cid:9) agee paid $l,491.", True)[0].startswith("The valuation report arrived when the")
    assert r.paragraphs("the agr�em ent permits", True) == ["the agreement permits"]


def test_paragraphs_over_page_ends(spark):
    assert reader().document(["The agreement permits dispo-\n1", "2\nsal of the coupe.", "", "without consent"], True) == [(0, "The agreement permits disposal of the coupe."), (3, "without consent")]
    assert len(reader().paragraphs("\n".join(["the agreement permits disposal of the"] * 200), True)) == 1
    rows = [(1, 7, 2, "sal of the coupe.\n\nEither side may"), (2, 7, 1, "The agreement permits dispo-"), (3, 7, 3, "demand an umpire."), (4, 7, 5, "under the provision"), (5, None, 1, "the loss"), (6, 8, 1, "the amount")]
    pages = spark.createDataFrame(rows, "page_id bigint, extraction_id bigint, page_number int, text string")
    results = spark.createDataFrame([(7, "tesseract@5", "the loss"), (9, "stdlib-email", "disposal " * 9)], "extraction_id bigint, method string, text string")
    got = {(r.src, r.row_id, r.paragraph_no): r.paragraph for r in repaired_paragraphs(pages, results).collect()}
    p = "page_results"
    assert got == {(p, 2, 1): "The agreement permits disposal of the coupe.", (p, 1, 2): "Either side may demand an umpire.", (p, 4, 3): "under the provision", (p, 5, 1): "the loss", (p, 6, 1): "the amount", ("extraction_results", 7, 1): "the loss"}


def test_furniture_of_a_document_and_limits_as_shares(spark):
    body = "the agreement permits disposal of the coupe without written consent\nunder the appraisal provision either side may demand an umpire"
    rows = [(1, 1, 1, f"Holmgate Records 5\n{body}"), (2, 1, 2, f"Holmgate Records 6\n{body}"), (3, 2, 1, f"Other Ledger 5\n{body}")]
    pages = spark.createDataFrame(rows, "page_id bigint, extraction_id bigint, page_number int, text string")
    results = spark.createDataFrame([], "extraction_id bigint, method string, text string")
    assert {(r.row_id, r.line_no) for r in line_defects(pages, results).collect() if r.defect == "running"} == {(1, 1), (2, 1)}
    large = Reader({**{w: 500_000 for w in WORDS}, "consenf": 4000, "disposai": 2})
    small = Reader({**{w: 500 for w in WORDS}, "consenf": 4})
    for w in ("consenf", "agreernent", "disposai", "umpire"):
        assert large.wrong(w) == small.wrong(w), w
    few = Reader({"filler": 840_000 * 20, "consenf": 20, "consent": 19 * 20})
    assert few.wrong("consenf") and Reader({"filler": 840_000, "consenf": 1, "consent": 19}).wrong("consenf")


def test_joint_segmentation_of_letters():
    """Blanks lost, put in or moved between known words, with confusions beside them, are undone in nine of ten places or more."""
    rng, r = random.Random(4), Reader({w: 500 for w in WORDS} | {"the": 60_000, "of": 30_000})
    long = [w for w in WORDS if len(w) > 4 and "-" not in w]
    right = total = 0
    for _ in range(200):
        words = [rng.choice(long) for _ in range(6)]
        k, kind = rng.randrange(1, 4), rng.choice(["lost", "put", "moved", "lost and misread"])
        a, b = words[k], words[k + 1]
        if kind == "put":
            c = rng.randrange(2, len(a) - 1)
            bad = [*words[:k], a[:c], a[c:], *words[k + 1 :]]
        elif kind == "moved":
            c = rng.randrange(1, 3)
            bad = [*words[:k], a + b[:c], b[c:], *words[k + 2 :]]
        else:
            bad = [*words[:k], a + (b if kind == "lost" else b.replace("e", "c", 1)), *words[k + 2 :]]
        total += 1
        right += r.paragraphs(" ".join(bad), False) == [" ".join(words)]
    assert right >= 0.9 * total, right / total
    assert r.paragraphs("the Holloway report of Tennashaw", False) == ["the Holloway report of Tennashaw"]
    assert r.meant("x" * 20_000) == "x" * 20_000 and r.meant("agreernent" * 400) == "agreernent" * 400


def test_any_number_of_running_lines_before_the_rest_of_a_word(spark):
    stamps = "\n".join(f"QPX{i:06d}" for i in range(30))
    rows = [(1, 7, 1, "The agreement permits\nthe dispo-"), (2, 7, 2, stamps + "\nsal of the coupe without\n" + "written consent\n" * 9)]
    pages = spark.createDataFrame(rows, "page_id bigint, extraction_id bigint, page_number int, text string")
    results = spark.createDataFrame([(9, "stdlib-email", " ".join(WORDS * 4))], "extraction_id bigint, method string, text string")
    got = {(r.row_id, r.line_no, r.defect) for r in line_defects(pages, results).collect()}
    assert (1, 2, "hyphen") in got and {(2, i, "running") for i in range(1, 31)} <= got
    assert repaired_paragraphs(pages, results).first().paragraph.startswith("The agreement permits the disposal of the coupe")
