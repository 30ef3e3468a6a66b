from docketry.llm import parties
from docketry.llm.parties import LEAST_SIMILAR, RECALL, ROWS, band_keys, bands_for, compare, edits, keys_of, likeness, monge_elkan, parse, part_likeness, party_members, party_pairs, profile, star_clusters, strength


def test_names():
    assert parse("Whiterridge, K. D.") == parse("Mx. KD Whiterridge") == parse("Whiterridge K D")
    assert parse("Dr. Charles A. Lombenard Sr.") == {"k": "p", "last": "lombenard", "first": "charles", "mid": "a", "suf": "sr"}
    assert parse("Restoration Company, Treverlock")["acr"] == parse("The Treverlock Restor. Co.")["acr"] == "trc" and parse("TRC") == {"k": "a", "acr": "trc"}
    assert parse("") is None and parse("?!") is None and parse("x" * 10_000) is not None


def test_comparison():
    c = lambda a, b: compare(parse(a), parse(b))
    assert c("Liz Pendaard", "Pendaard, Elizabeth") == 3 and c("Itgrid Whitiskin", "Ingrid Whitiskiin") == 3 and c("K. Pendaard", "Kenji Pendaard") == 1
    assert c("May Quentmere", "Victoria Quentmere") == -1 and c("Charles Lombenard Jr.", "Chuck Lombenard Sr.") == -1 and c("Ann Lee", "Bob Stone") == 0
    assert c("Muskerridge Cas. Grp", "Muskerrdige Casualty Group") == 3 and c("Brackoso Medical", "Brackoso Collision") == -1 and c("WMIC", "The Waldisard Mutual Insurance Company LLC") == 1
    office = lambda n: profile([n], ["office@x.example"])
    assert strength(office("Ann Lee"), office("Bob Stone")) == 0
    assert edits("abcd", "abdc") == 1 and likeness("", "a") == 0 and monge_elkan(("a",), ()) == 0


def test_collision_curve():
    b = bands_for()
    assert 1 - (1 - LEAST_SIMILAR**ROWS) ** b >= RECALL > 1 - (1 - LEAST_SIMILAR**ROWS) ** (b - 1)
    words = ["whiterridge", "brackeraux", "quentmere", "lombenard", "treverlock", "muskerridge", "cormacroft", "fennismere"]
    pairs = [(w, w[:i] + w[i + 1 :]) for w in words for i in range(len(w))] + [(w, w[:i] + "z" + w[i:]) for w in words for i in range(len(w))]
    assert sum(bool(set(band_keys(a)) & set(band_keys(b))) for a, b in pairs) >= 0.95 * len(pairs)


ENTITY = "entity_no bigint, case_id string, display_name string, match_emails array<string>, match_names array<string>"


def test_parties_of_a_case(spark):
    rows = [
        (1, "c", None, None, ["Ingrid Whitiskin"]), (2, "c", "Whitiskin, Ingrid", [], []), (3, "c", None, ["ingrid.whitiskin@x.example"], ["I. Whitiskin"]), (4, "d", None, None, ["Ingrid Whitiskin"]),
        (5, "c", None, None, ["Olaf Whitiskin"]), (6, "c", None, ["office@k.example"], ["Kellokin Towing and Recovery"]), (7, "c", None, None, ["Kelllokin Towing & Recovery", None]), (8, "c", None, None, None), (9, None, "x", None, None),
        (10, "c", None, None, ["KTR"]), (11, "c", None, ["p@x.example"], ["P. Same"]), (12, "c", None, ["P@X.example"], ["Priya Same"]),
    ]
    e = spark.createDataFrame(rows, ENTITY)
    calls = spark.createDataFrame([(100, "c", "whitiskin ingrid"), (101, "c", "Ingrid Whitskin"), (102, "c", None), (103, "c", "Wireless Caller"), (104, "d", "Ingrid Whitiskin"), (105, "c", "Kellokin Towing"), (106, "INTAKE", "Ingrid Whitiskin")], "call_id bigint, case_id string, name string")
    got = {(r.src, r.left_id, r.right_id) for r in party_pairs(e, calls).collect()}
    assert {x for x in got if x[0] == "entities"} == {("entities", a, b) for a, b in ((1, 2), (1, 3), (2, 3), (6, 7), (6, 10), (7, 10), (11, 12))}
    assert {x for x in got if x[0] == "call_log"} >= {("call_log", 101, 1), ("call_log", 104, 4), ("call_log", 105, 6)} and not any(x[1] in (102, 103, 106) for x in got if x[0] == "call_log")
    members = {r.entity_no: r.party_no for r in party_members(e).collect()}
    assert members[3] == 1 and members[5] == 5 and members[12] == 11
    assert party_pairs(e.limit(0), calls).count() == 0


def test_clusters_of_a_long_chain(spark):
    n = 100  # falling strengths: one centre and its neighbours a round, 50 rounds
    nodes = spark.createDataFrame([("c", i) for i in range(n)], "case_id string, id bigint").coalesce(1)
    edges = spark.createDataFrame([("c", i, i + 1, 9.0 - i / 100) for i in range(n - 1)], "case_id string, a bigint, b bigint, s double").coalesce(1)
    got = {r.id: r.center for r in star_clusters(nodes, edges).collect()}
    assert got == {0: 1, **{i: i if i % 2 else i - 1 for i in range(1, n)}}


def test_names_that_parse_poorly():
    same = lambda a, b: strength(profile([a], []), profile([b], [])) >= 2 and bool(keys_of(profile([a], [])) & keys_of(profile([b], [])))
    for a, b in (
        ("Auto Glass Center", "Auto Glass Ctr."), ("Medical Associates", "Medical Associates"), ("Legal Services Group", "Services Group, Legal"), ("Иван Петров", "Петров, Иван"), ("王小明", "王小明"), ("王 明", "王 明"),
        ("Γιώργος Παππάς", "Γιώργος Παππάς"), ("राम शर्मा", "राम शर्मा"), ("Ingrid", "ingrid"), ("Bill Wu", "William Wu"), ("bill wu", "Wu, Bill"), ("BILL WU", "Bill Wu"), ("Dmitri Ng", "Ng, Dmitri"),
    ):
        assert same(a, b), (a, b)
    for a, b in (
        ("Auto Glass Center", "Auto Body Center"), ("A & B Towing", "C & D Towing"), ("Medical Associates", "Medical Center"), ("Иван Петров", "Олег Петров"), ("王小明", "王小红"), ("王 明", "王 红"), ("Ingrid", "Sofia"),
        ("Whiterridge", "Whiterridge"), ("Bill Wu", "Bill Xu"), ("Ann Wu", "Bill Wu"), ("Wang", "王小明"),
    ):
        assert not same(a, b), (a, b)
    assert parse("whiterridge kd") == parse("Whiterridge KD") == parse("WHITERRIDGE KD") == parse("Whiterridge, K. D.")


def test_copies_and_a_hot_key(spark, monkeypatch):
    monkeypatch.setattr(parties, "HOT", 20)
    rows = [(i, "c1", f"e{i}", "neutral", None, ["Jonathan Merriweather"] if i % 3 else ["Jon Meriweather"], None) for i in range(60)] + [(100, "c1", "x", None, None, ["Merriweather"], None), (101, "c1", "y", None, None, ["Merriweather"], None)]
    df = spark.createDataFrame(rows, "entity_no bigint, case_id string, entity_id string, role string, display_name string, match_names array<string>, match_emails array<string>")
    got = {r.entity_no: (r.party_no, r.links) for r in party_members(df).collect()}
    assert len(got) == 62 and all(got[i] == (0, 59) for i in range(60)) and got[100] == (100, 0) and got[101] == (101, 0)


def test_monge_elkan_over_the_parts_of_peoples_names():
    like = lambda a, b: monge_elkan(tuple(a.split()), tuple(b.split()), part_likeness)
    assert like("smith bob", "smith robert") == 1.0 and like("smith r", "smith robert") > 0.9 and like("smyth robert", "smith robert") > 0.8
    assert like("smith robert", "jones robert") < 0.8 and like("smith anna", "smith walter") < 0.8
