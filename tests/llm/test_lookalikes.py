import math
import random
import unicodedata
from collections import Counter

from docketry.llm.lookalikes import CYRILLIC_TWINS, GREEK_TWINS, Decoder, canonical_texts, look_classes, look_pairs, pair_counts, skeleton

TEXTS = ["The carrier paid $1,234.00 for 13 m² of glass - see file CL-00005ZZ.", "Страховая компания не дала ответ в срок, см. письмо.", "Le café de Zürich n'a pas reçu la pièce.", "AN OX IS A COP", ""]


def disguise(t, rng):
    out = []
    for c in t:
        k = rng.random()
        if k < 0.15 and "!" < c <= "~":
            c = chr(ord(c) + 0xFEE0)
        elif k < 0.3:
            c = rng.choice([CYRILLIC_TWINS, GREEK_TWINS]).get(c, c)
        elif k < 0.4 and c == " ":
            c = " "
        elif k < 0.5:
            c += "​"
        out.append(c)
    return unicodedata.normalize(rng.choice(["NFC", "NFD"]), "".join(out))


def test_disguises_have_one_form_and_other_texts_another():
    d, rng = Decoder({(k, p): -1.0 for (k, p), _ in pair_counts(TEXTS).items()}), random.Random(3)
    for t in TEXTS:
        forms = {d.canonical(disguise(t, rng)) for _ in range(30)}
        assert forms == {d.canonical(t)}
    differ = ["café", "cafe", "Cafe", "m²", "m2", "a b", "ab", "résumé", "resume", "O0", "0O", "–", "-"]
    assert len({d.canonical(t) for t in differ}) == len(differ)
    assert d.canonical(TEXTS[0]) == TEXTS[0] and d.canonical(TEXTS[1]) == TEXTS[1] and d.canonical("ﬁle­name") == "filename" and d.canonical("еarly") == "early"


def test_pairs_against_brute_force(spark):
    rng, rows = random.Random(9), []
    for i in range(120):
        t = rng.choice(TEXTS[:4])
        rows.append((i, None if i == 7 else "" if i == 8 else t if rng.random() < 0.5 else disguise(t, rng)))
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    key = {i: unicodedata.normalize("NFC", skeleton(t or "")) for i, t in rows}
    raw = {i: t or "" for i, t in rows}
    want = {(a, b) for a in key for b in key if a < b and key[a] == key[b] and raw[a] != raw[b]}
    assert {tuple(r) for r in look_pairs(df).collect()} == want and want
    classes = {r.doc_id: r for r in look_classes(df).collect()}
    assert len(classes) == len(rows) and all((classes[a].class_id == classes[b].class_id) == (key[a] == key[b]) for a in key for b in key)
    assert look_pairs(df.limit(0)).count() == 0 and canonical_texts(df).count() == len(rows)


def test_hot_group_of_exact_copies_gives_no_pairs(spark):
    df = spark.range(3000).selectExpr("id as doc_id", "case when id % 3 = 0 then 'the same text' else concat('text ', id) end as text")
    assert look_pairs(df).count() == 0


def test_very_long_text():
    d = Decoder({})
    assert len(d.canonical("о" * 100_000 + " " + "word " * 20_000)) == 200_001


READ = {"the Ӏetter": "the letter", "my Ӏnsurance": "my Insurance", "in 2߀24": "in 2024", "the r߀ad": "the road", "a ǀabeǀ": "a label", "Ӏt is": "It is", "1З5 miles": "135 miles", "Закон": "Закон", "caӏӏ me": "call me"}


def test_search_decides_signs_with_several_readings():
    """With counts of letter pairs the word tells the reading; without them most are wrong."""
    corpus = ["The letter and the Insurance label; It is on Oak Road 2024, the road 135 miles long. Call me, all is well. Закон о сроке, см. Заявление"] * 3
    counts = pair_counts(corpus)
    heads = Counter()
    for (k, p), n in counts.items():
        heads[k, p[0]] += n
    model = {(k, p): math.log((n + 0.1) / (heads[k, p[0]] + 20)) for (k, p), n in counts.items()}
    right = lambda d: sum(d.canonical(a) == b for a, b in READ.items())
    assert right(Decoder(model)) == len(READ) and right(Decoder({})) < len(READ) - 2


def test_letters_of_other_scripts_and_visible_joiners():
    d = Decoder({})
    assert d.canonical("ⅼetter") == "letter" and d.canonical("cօpy") == "copy" and d.canonical("ᎪB ꓑ") == "AB P"
    assert d.canonical("می‌خواهم") != d.canonical("میخواهم") and d.canonical("cl‌aim") == "claim" and d.canonical("क‍ष‌") == "क‍ष"
    assert d.canonical("می‌‌خواهم") == d.canonical("می‌خواهم")


def test_one_variant_beside_many_copies(spark):
    df = spark.range(4000).selectExpr("id as doc_id", "case when id = 7 then 'thе same text' else 'the same text' end as text")
    got = look_pairs(df).collect()
    assert len(got) == 3999 and all(7 in (r.doc_a, r.doc_b) and r.doc_a < r.doc_b for r in got)
    links = {r.doc_id: r.links for r in look_classes(df).collect()}
    assert links[7] == 3999 and links[8] == 1
