"""Variant spellings of people and organisations: which rows are one party, and which party a caller is."""

from __future__ import annotations

import json
import re
import unicodedata
from functools import lru_cache, reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docketry.llm.given_names import GIVEN, NICKNAMES, TITLES
from docketry.runtime import materialize, salted_join

# Words of organisation names and their short forms.
ORG_WORDS = {
    "company": "company", "co": "company", "corporation": "corporation", "corp": "corporation", "group": "group", "grp": "group", "mutual": "mutual", "mut": "mutual", "insurance": "insurance",
    "ins": "insurance", "indemnity": "indemnity", "indem": "indemnity", "casualty": "casualty", "cas": "casualty", "medical": "medical", "med": "medical", "associates": "associates",
    "assoc": "associates", "assocs": "associates", "restoration": "restoration", "restor": "restoration", "towing": "towing", "tow": "towing", "recovery": "recovery", "rec": "recovery",
    "auto": "auto", "automotive": "auto", "body": "body", "bdy": "body", "glass": "glass", "collision": "collision", "coll": "collision", "center": "center", "centre": "center", "ctr": "center",
    "services": "services", "service": "services", "svcs": "services", "svc": "services", "legal": "legal", "appraisal": "appraisal", "appr": "appraisal", "law": "law", "office": "office",
    "clinic": "clinic", "hospital": "hospital", "hosp": "hospital", "bank": "bank", "partners": "partners", "adjusters": "adjusters", "agency": "agency", "agcy": "agency",
    "assurance": "assurance", "underwriters": "underwriters", "motors": "motors", "garage": "garage", "repair": "repair", "claims": "claims", "department": "department", "dept": "department",
}
_LEGAL = {"llc", "inc", "ltd", "llp", "pllc", "plc", "pc", "lp", "incorporated", "limited", "the"}
_SUFFIX = {"jr": "jr", "sr": "sr", "junior": "jr", "senior": "sr", "ii": "ii", "iii": "iii", "iv": "iv"}
_DEGREE = {"md", "esq", "phd", "dds", "cpa", "jd", "rn"}
#: Mailbox names that belong to an office, not to a person.
OFFICE = {"office", "claims", "front.desk", "frontdesk", "info", "contact", "admin", "support", "billing", "reception", "mail", "hello", "service", "help", "sales"}

#: Padded q-grams, hash rows a band, the similarity of q-gram sets still to be found, and the recall wanted there.
Q, ROWS, LEAST_SIMILAR, RECALL = 2, 2, 0.42, 0.98


def bands_for(similar: float = LEAST_SIMILAR, recall: float = RECALL, rows: int = ROWS) -> int:
    """Least number of bands b with 1 - (1 - s^rows)^b >= recall at similarity s: the collision curve solved for b."""
    b = 1
    while 1 - (1 - similar**rows) ** b < recall:
        b += 1
    return b


def qgrams(word: str, q: int = Q) -> set[str]:
    padded = "#" * (q - 1) + word + "$" * (q - 1)
    return {padded[i : i + q] for i in range(len(padded) - q + 1)}


@lru_cache(maxsize=1)
def _rows() -> tuple[np.ndarray, np.ndarray]:
    """Factors and summands of the hash functions, one for each row of each band."""
    import xxhash

    n = bands_for() * ROWS
    draw = lambda what: np.array([xxhash.xxh64_intdigest(f"{what}{i}") for i in range(n)], dtype=np.uint64)
    return draw("factor") | np.uint64(1), draw("summand")


@lru_cache(maxsize=200_000)
def band_keys(word: str) -> tuple[str, ...]:
    """MinHash bands of a word's padded q-grams: each gram is hashed once, the rows' functions are linear in that."""
    import xxhash

    grams = np.array([xxhash.xxh64_intdigest(g) for g in qgrams(word)], dtype=np.uint64)
    factor, summand = _rows()
    least = ((grams[:, None] * factor + summand) >> np.uint64(32)).min(axis=0).tolist()
    return tuple(f"{b}:" + ":".join(f"{v:x}" for v in least[b * ROWS : (b + 1) * ROWS]) for b in range(len(least) // ROWS))


@lru_cache(maxsize=200_000)
def edits(a: str, b: str) -> int:
    """Edit distance with swaps of neighbours as one edit."""
    if a == b:
        return 0
    while a and b and a[0] == b[0]:
        a, b = a[1:], b[1:]
    while a and b and a[-1] == b[-1]:
        a, b = a[:-1], b[:-1]
    if not a or not b:
        return len(a) + len(b)
    before, last = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            v = min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                v = min(v, before[j - 2] + 1)
            row.append(v)
        before, last = last, row
    return last[-1]


@lru_cache(maxsize=200_000)
def likeness(a: str, b: str) -> float:
    """1 - edits / length of the longer word, with a bonus for a common beginning."""
    if not a or not b:
        return 0.0
    s = 1 - edits(a, b) / max(len(a), len(b))
    head = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    return s + min(4, head) * 0.05 * (1 - s)


def monge_elkan(a: tuple[str, ...], b: tuple[str, ...], like=likeness) -> float:
    """Mean over the words of each name of the best likeness in the other name; the smaller of both directions."""
    if not a or not b:
        return 0.0
    one = lambda x, y: sum(max(like(p, r) for r in y) for p in x) / len(x)
    return min(one(a, b), one(b, a))


def _shortened(word: str) -> set[str]:
    """The word, and the word without any one of its letters."""
    return {word, *(word[:i] + word[i + 1 :] for i in range(len(word)))}


@lru_cache(maxsize=2)
def _neighbours(which: str) -> dict[str, list[str]]:
    """Known words under each of their shortened forms: two words one edit apart have one in common."""
    out: dict[str, list[str]] = {}
    for w in (*GIVEN, *NICKNAMES) if which == "given" else ORG_WORDS:
        if len(w) >= (3 if which == "given" else 5):
            for form in _shortened(w):
                out.setdefault(form, []).append(w)
    return out


def _one_edit(word: str, which: str) -> list[str]:
    """Known words at most one edit away."""
    known = _neighbours(which)
    met = dict.fromkeys(w for form in _shortened(word) for w in known.get(form, ()))
    return [w for w in met if abs(len(w) - len(word)) <= 1 and edits(w, word) <= 1]


@lru_cache(maxsize=200_000)
def given_of(word: str) -> str:
    """The given name a word stands for: itself, its long form, or the nearest known name one edit away."""
    if word in NICKNAMES:
        return NICKNAMES[word]
    if word in GIVEN or len(word) < 4:
        return word
    long = {NICKNAMES.get(g, g) for g in _one_edit(word, "given")}
    return long.pop() if len(long) == 1 else word


#: Monge-Elkan similarity from which the names of two people, or the telling words of two organisations, may be one.
PERSON_ALIKE, ORG_ALIKE = 0.80, 0.78


@lru_cache(maxsize=200_000)
def part_likeness(a: str, b: str) -> float:
    """Likeness of two parts of people's names: short forms count as their long form, an initial as most of a name that begins with it."""
    x, y = given_of(a), given_of(b)
    if a == b or x == y:
        return 1.0
    if len(a) == 1 or len(b) == 1:
        one, full, long = (a, b, y) if len(a) == 1 else (b, a, x)
        return 0.9 if one in (full[:1], long[:1]) else 0.0
    return max(likeness(a, b), likeness(x, y))


def person_words(p: dict) -> tuple[str, ...]:
    return tuple(w for w in (*re.split(r"[ -]", p["last"]), p["first"]) if w)


@lru_cache(maxsize=200_000)
def org_word(word: str) -> str | None:
    if word in ORG_WORDS:
        return ORG_WORDS[word]
    near = _one_edit(word, "org") if len(word) >= 5 else []
    return ORG_WORDS[min(near, key=list(ORG_WORDS).index)] if near else None


def _spelled(text: str) -> list[str]:
    """Words of letters of any script with their marks; apostrophes and inner hyphens belong to them."""
    kept = "".join(c if c in "'-" or unicodedata.category(c)[0] in "LM" else " " for c in text)
    return re.findall(r"[^\s-]+(?:-[^\s-]+)*", kept)


def _cased(word: str) -> bool:
    """Whether a word's script has capitals, so that a single letter is an initial; elsewhere it is a whole name."""
    return word.lower() != word.upper()


def parse(name: str) -> dict | None:
    """The parts of a name: kind p (person), o (organisation), a (initials of an organisation) or w (one word that is the whole name)."""
    raw = unicodedata.normalize("NFKD", name)
    raw = "".join(c for c in raw if not unicodedata.combining(c)).replace("&", " and ").replace("’", "'")
    raw = re.sub(r"\b([A-Za-z])\.(?=[A-Za-z]\.)", r"\1", raw)  # L.L.C. -> LLC.
    halves = [_spelled(h) for h in re.split("[,،、，]", raw)]
    halves = [h for h in halves if h]
    if not halves:
        return None
    flat = [w.lower() for h in halves for w in h]
    plain = [w for w in flat if w not in _LEGAL and w not in TITLES and w not in _DEGREE]
    if not plain:
        return None
    if any(org_word(w) for w in plain) and not (len(plain) == 2 and plain[0] in GIVEN and plain[1] not in ORG_WORDS):
        words = [w for w in plain if w != "and" and len(w) > 1 or len(plain) == 1]
        lead = [w for w in words if not org_word(w)]
        rest = [org_word(w) for w in words if org_word(w)]
        order = [w for w in plain if w not in ("and", "of")]
        if len(halves) > 1 and not org_word(order[-1]):  # Restoration Company, Lead
            order = order[-1:] + order[:-1]
        return {"k": "o", "lead": lead, "rest": rest, "acr": "".join(w[0] for w in order)}
    if len(halves) == 1 and len(plain) == 1 and re.fullmatch(r"[A-Z]{2,5}", halves[0][-1]) and not (plain[0] in GIVEN or plain[0] in NICKNAMES):
        return {"k": "a", "acr": plain[0]}
    suffix = next((_SUFFIX[w] for w in flat if w in _SUFFIX), "")
    clean = [[w for w in (x.lower() for x in h) if w not in TITLES and w not in _SUFFIX and w not in _DEGREE and w not in _LEGAL] for h in halves]
    clean = [h for h in clean if h]
    if not clean:
        return None
    short = lambda w: _cased(w) and (len(w) == 1 or len(w) == 2 and w not in GIVEN and w not in NICKNAMES)
    # a last word of two letters is a surname if it is written as a word, or if case tells nothing and a given name stands before it
    written = [w for h in halves for w in h if w.lower() in clean[0]]
    mixed = len({w.isupper() for w in written}) > 1 or any(w[:1].isupper() and not w.isupper() for w in written)
    brief = len(clean) == 1 and len(clean[0]) > 1 and len(clean[0][-1]) == 2 and _cased(clean[0][-1]) and len(clean[0][0]) > 1
    brief = brief and (written[-1].istitle() if mixed else clean[0][0] in GIVEN or clean[0][0] in NICKNAMES)
    if len(clean) > 1:
        last, firsts = " ".join(clean[0]), clean[1]
    else:
        w = clean[0]
        if len(w) == 1:
            if not _cased(w[0]) and len(w[0]) > 1:
                return {"k": "w", "name": w[0]}
            known = w[0] in GIVEN or w[0] in NICKNAMES
            return {"k": "p", "last": "" if known else w[0], "first": w[0] if known else "", "mid": "", "suf": suffix}
        if all(short(x) for x in w[1:]) and not brief:
            last, firsts = w[0], w[1:]
        else:
            last, firsts = w[-1], w[:-1]
    letters = []
    for x in firsts:
        letters += list(x) if short(x) else [x]
    return {"k": "p", "last": last.replace("'", ""), "first": letters[0] if letters else "", "mid": letters[1][0] if len(letters) > 1 else "", "suf": suffix}


def profile(names: list[str], emails: list[str]) -> dict:
    """All a row tells of its party: parsed names, personal mailboxes, office mailboxes."""
    parsed, seen = [], set()
    for n in names:
        if n and (p := parse(n)) and (key := json.dumps(p, sort_keys=True)) not in seen:
            seen.add(key)
            parsed.append(p)
    mine, office = set(), set()
    for m in emails:
        m = re.sub(r"\s", "", (m or "").lower()).strip("<>")
        if "@" in m:
            (office if m.split("@")[0] in OFFICE else mine).add(m)
    for p in list(parsed):  # a mailbox may spell out the given name of an initial
        if p["k"] == "p" and len(p["first"]) <= 1 and p["last"]:
            for m in mine:
                local = re.sub(r"[\d._+-]|claims", "", m.split("@")[0])
                at = local.find(p["last"])
                given = local[:at] if at > 0 else ""
                if len(given) >= 3 and (not p["first"] or given[0] == p["first"] or given_of(given)[0] == p["first"]):
                    parsed.append(p | {"first": given})
    for p in list(parsed):  # an office's mailbox may spell out the first of its initials
        if p["k"] == "a":
            for m in office:
                lead = re.sub(r"[^a-z]", "", m.split("@")[1].split(".")[0])
                if len(lead) > 3 and lead[0] == p["acr"][0]:
                    parsed.append({"k": "o", "lead": [lead], "rest": [], "acr": p["acr"]})
    return {"n": parsed, "m": sorted(mine), "o": sorted(office)}


def keys_of(prof: dict) -> set[str]:
    """Blocking keys: bands of the telling words, initials of organisations, personal mailboxes.

    Bands of a surname are keyed with the initial of the given name and of its long form, as people of one
    surname alone are no candidates; a given name whose first letter is mistyped is found by its rest
    beside the same surname, a surname with many mistakes by its initial beside the same given name. Initials of full names (``x:``) meet only names known by initials (``y:``).
    """
    out: set[str] = set()
    for p in prof["n"]:
        if p["k"] == "p":
            if p["last"] and p["first"]:
                starts = {p["first"][0], given_of(p["first"])[0]}
                for w in re.split(r"[ -]", p["last"]):
                    if len(w) > 1:
                        out.update(f"{k}|{i}" for k in band_keys(w) for i in starts)
                if len(p["first"]) > 1:
                    out.update((f"t:{p['last']}|{given_of(p['first'])[1:]}", f"u:{given_of(p['first'])}|{p['last'][0]}"))
                out.add("x:" + p["first"][0] + p["last"][0])
            elif p["first"]:
                out.add("f:" + p["first"])
        elif p["k"] == "w":
            out.add("f:" + p["name"])
        elif p["k"] == "o":
            for w in p["lead"]:
                if len(w) > 2:
                    out.update(band_keys(w))
            if not p["lead"]:
                out.add("f:" + " ".join(sorted(p["rest"])))
            out.add("x:" + p["acr"])
        else:
            out.update(("y:" + p["acr"], "A:" + p["acr"]))
    out.update("m:" + m for m in prof["m"])
    return out


_SAME, _MAYBE, _NO, _CONFLICT = 3, 1, 0, -1


def _near(a: str, b: str) -> bool:
    d = edits(a, b)
    return d == 0 or d <= (1 if min(len(a), len(b)) < 7 else 2) and likeness(a, b) >= 0.72


def compare(p: dict, q: dict) -> int:
    """3: the same party, 1: may be the same, 0: nothing told, -1: different parties."""
    if p["k"] == "w" and q["k"] == "w":
        return _SAME if p["name"] == q["name"] else _NO
    if p["k"] == "p" and q["k"] == "p":
        if not p["last"] and not q["last"]:  # a given name is all that is known; a surname alone makes no party
            return 2 if len(p["first"]) > 1 and (p["first"], p["suf"]) == (q["first"], q["suf"]) else _NO
        if not p["last"] or not q["last"]:
            return _NO
        if not _near(p["last"], q["last"]):
            return _NO
        if p["suf"] and q["suf"] and p["suf"] != q["suf"]:
            return _CONFLICT
        if p["mid"] and q["mid"] and p["mid"] != q["mid"]:
            return _CONFLICT
        a, b = p["first"], q["first"]
        if not a or not b:
            return _NO
        if not _cased(a) or not _cased(b):
            return _SAME if a == b else _CONFLICT
        alike = lambda: monge_elkan(person_words(p), person_words(q), part_likeness) >= PERSON_ALIKE
        if len(a) == 1 or len(b) == 1:
            full, one = (b, a) if len(a) == 1 else (a, b)
            if part_likeness(full, one) > 0:
                return (2 if p["mid"] and q["mid"] else _MAYBE) if alike() else _NO
            return _CONFLICT
        two_known = given_of(a) != given_of(b) and given_of(a) in GIVEN and given_of(b) in GIVEN
        if (edits(a, b) <= 1 or part_likeness(a, b) >= 0.72 and not two_known) and alike():
            return _SAME if not (bool(p["suf"]) ^ bool(q["suf"])) else 2
        return _CONFLICT
    if p["k"] == "o" and q["k"] == "o":
        if not p["lead"] and not q["lead"]:  # generic words only: the same words, initials of all others included
            return _SAME if sorted(p["rest"]) == sorted(q["rest"]) and sorted(p["acr"]) == sorted(q["acr"]) else _NO
        if not p["lead"] or not q["lead"]:
            return _NO
        if monge_elkan(tuple(p["lead"]), tuple(q["lead"])) < ORG_ALIKE:
            return _NO
        a, b = set(p["rest"]), set(q["rest"])
        kinds = {"company", "corporation", "group", "center", "services", "associates", "and"}
        if a <= b or b <= a or (a - kinds) & (b - kinds):
            return _SAME
        return _CONFLICT
    if {p["k"], q["k"]} == {"a", "o"}:
        return _MAYBE if p["acr"] == q["acr"] else _NO
    if {p["k"], q["k"]} == {"a", "p"}:
        a, x = (p, q) if p["k"] == "a" else (q, p)
        return _MAYBE if x["last"] and x["first"] and a["acr"] == x["first"][0] + x["last"][0] else _NO
    if p["k"] == "a" and q["k"] == "a":
        return 2 if p["acr"] == q["acr"] else _NO
    return _NO


def strength(x: dict, y: dict) -> float:
    """How surely two profiles are one party: 0 not, below 2 weakly, from 2 on surely.

    All spellings are compared; one that contradicts outweighs those that agree, unless the agreement is
    complete. A mailbox of an office supports a match of names and makes none by itself.
    """
    found = [compare(p, q) for p in x["n"] for q in y["n"]]
    best, worst = max(found, default=0), min(found, default=0)
    mail, office = bool(set(x["m"]) & set(y["m"])), bool(set(x["o"]) & set(y["o"]))
    if worst == _CONFLICT and best < _SAME and not mail:
        return 0.0
    if worst == _CONFLICT and best >= _SAME:
        return 1.2 if sum(f == _CONFLICT for f in found) * 2 > len(found) else 2.2 + 0.5 * mail
    if mail:
        return max(3.0, best + 1.0) if worst != _CONFLICT else 0.0
    if best == _MAYBE and office:
        return 2.2
    return float(best)


# tables ------------------------------------------------------------------------------------------

_PROFILE = "case_id string, kind int, id bigint, prof string, sure boolean, keys array<bigint>, asks array<bigint>"
#: Rows of one blocking key from which the key's rows are spread over salts.
HOT = 1_000


def _profiles(rows: DataFrame) -> DataFrame:
    """rows: (case_id, kind, id, names, emails) -> profiles with the digests of their blocking keys.

    ``keys`` are what a profile is found by, ``asks`` what it looks for: the same, but for initials, which
    full names and names known by initials look for in each other. ``sure``: a second row of the same
    profile is the same party.
    """

    def build(batches):
        import xxhash

        for b in batches:
            profs = [profile([*(n if n is not None else [])], [*(m if m is not None else [])]) for n, m in zip(b["names"], b["emails"])]
            keys, asks = [], []
            for case, p in zip(b["case_id"], profs):
                found = sorted(keys_of(p))
                digest = lambda k, case=case: xxhash.xxh64_intdigest(f"{case}\t{k}") - (1 << 63)
                keys.append([digest(k) for k in found])
                asks.append([digest({"x:": "y:", "y:": "x:"}.get(k[:2], k[:2]) + k[2:]) for k in found])
            yield pd.DataFrame({"case_id": b["case_id"], "kind": b["kind"], "id": b["id"], "prof": [json.dumps(p) for p in profs], "sure": [strength(p, p) >= 2 for p in profs], "keys": keys, "asks": asks})

    spread = 2 * rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(spread, "id").mapInPandas(build, _PROFILE)


def _strengths(a: pd.Series, b: pd.Series) -> pd.Series:
    loads = lru_cache(maxsize=50_000)(json.loads)
    score = lru_cache(maxsize=50_000)(lambda x, y: strength(loads(x), loads(y)))
    return pd.Series([score(x, y) for x, y in zip(a, b)], dtype="float64")


def _candidates(left: DataFrame, right: DataFrame, same: bool) -> DataFrame:
    """Distinct (a, b) that share a blocking key; each pair once, whatever the number of keys it shares.

    The rows of a key that many share are compared in blocks: one side's are spread over salts, to each of
    which the other's are copied.
    """
    l = left.select(F.col("id").alias("a"), F.explode("asks").alias("key"))
    r = right.select(F.col("id").alias("b"), F.explode("keys").alias("key"))
    hot = materialize(l.groupBy("key").count().where(F.col("count") >= HOT).select("key"))
    pairs = l.join(r, "key") if hot.isEmpty() else l.join(hot, "key", "left_anti").join(r, "key")
    if not hot.isEmpty():
        pairs = pairs.unionByName(salted_join(l.join(hot, "key", "left_semi"), r.join(hot, "key", "left_semi"), ["key"], salt_on=F.col("a"), salts=32))
    return (pairs.where(F.col("a") < F.col("b")) if same else pairs).select("a", "b").distinct()


def _scored(pairs: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """(case_id, a, b, s) of the pairs of one case whose names and mailboxes tie them."""
    l = left.select("case_id", F.col("id").alias("a"), F.col("prof").alias("pa"))
    r = right.select(F.col("case_id").alias("other"), F.col("id").alias("b"), F.col("prof").alias("pb"))
    met = pairs.join(l, "a").join(r, "b").where(F.col("case_id") == F.col("other"))
    return met.select("case_id", "a", "b", F.pandas_udf(_strengths, "double")("pa", "pb").alias("s")).where(F.col("s") > 0)


def star_clusters(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(case_id, id, center): star clustering of a weighted graph, in rounds of joins. Nodes may have ``copies``, which count in the weight of their neighbours and their own.

    In each round every free node that is stronger (sum of its edges' strength, then smaller id) than all
    its free neighbours becomes a centre, and its free neighbours join the centre they are tied to most
    surely. A node without edges is its own centre. The rounds end when no node is free: the strongest free
    node is beaten by none, so each settles at least one. Each is cut off by a checkpoint and moves only ids.
    """
    both = materialize(edges.select("case_id", F.col("a").alias("id"), F.col("b").alias("to"), "s").unionByName(edges.select("case_id", F.col("b").alias("id"), F.col("a").alias("to"), "s")))
    if "copies" in nodes.columns:
        size = nodes.select("case_id", "id", "copies")
        near = both.join(size.select("case_id", F.col("id").alias("to"), "copies"), ["case_id", "to"]).groupBy("case_id", "id").agg(F.sum(F.col("s") * F.col("copies")).alias("w"))
        weight = near.join(size, ["case_id", "id"]).select("case_id", "id", (F.col("w") + 3.0 * (F.col("copies") - 1)).alias("w"))
    else:
        weight = both.groupBy("case_id", "id").agg(F.sum("s").alias("w"))
    lone = nodes.join(weight, ["case_id", "id"], "left_anti").select("case_id", "id", F.col("id").alias("center"))
    free = materialize(weight)
    done = [lone]
    while not free.isEmpty():
        live = both.join(free.select("case_id", F.col("id"), F.col("w")), ["case_id", "id"]).join(free.select("case_id", F.col("id").alias("to"), F.col("w").alias("wt")), ["case_id", "to"])
        beaten = (F.col("wt") > F.col("w")) | ((F.col("wt") == F.col("w")) & (F.col("to") < F.col("id")))
        losers = live.where(beaten).select("case_id", "id").distinct()
        centers = materialize(free.join(losers, ["case_id", "id"], "left_anti").select("case_id", "id"))
        near = live.join(centers.select("case_id", F.col("id").alias("to")), ["case_id", "to"])
        best = near.groupBy("case_id", "id").agg(F.max(F.struct("s", "wt", -F.col("to"))).alias("m"))
        joined = best.select("case_id", "id", (-F.col("m.col3")).alias("center"))
        new = materialize(joined.unionByName(centers.select("case_id", "id", F.col("id").alias("center"))))
        done.append(new)
        if len(done) == 32:  # keeps the plan small in long runs
            done = [materialize(reduce(DataFrame.unionByName, done))]
        free = materialize(free.join(new.select("case_id", "id"), ["case_id", "id"], "left_anti"))
    return materialize(reduce(DataFrame.unionByName, done))


def _entity_rows(entities: DataFrame) -> DataFrame:
    names = F.concat(F.coalesce("match_names", F.array().cast("array<string>")), F.when(F.col("display_name").isNotNull(), F.array("display_name")).otherwise(F.array().cast("array<string>")))
    keyed = entities.where(F.col("entity_no").isNotNull() & F.col("case_id").isNotNull())
    return keyed.select("case_id", F.lit(0).alias("kind"), F.col("entity_no").alias("id"), names.alias("names"), F.col("match_emails").alias("emails"))


def _clustered(entities: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(profiles of one row each of equal entities, their clusters, the row that stands for each entity)."""
    every = materialize(_profiles(_entity_rows(entities)))
    own = F.when(~F.col("sure"), F.col("id"))
    groups = every.groupBy("case_id", "prof", own.alias("own")).agg(F.min("id").alias("id"), F.count("*").alias("copies"))
    stands = every.select("case_id", "prof", own.alias("own"), F.col("id").alias("entity_no"))
    same = groups.select(F.col("case_id").alias("c2"), F.col("prof").alias("p2"), F.col("own").alias("o2"), "id")
    stands = stands.join(same, (F.col("case_id") == F.col("c2")) & (F.col("prof") == F.col("p2")) & F.col("own").eqNullSafe(F.col("o2"))).select("case_id", "entity_no", "id")
    profs = materialize(every.join(groups.select("case_id", "id", "copies"), ["case_id", "id"]))
    scored = materialize(_scored(_candidates(profs, profs, True), profs, profs))
    # a weak tie counts only where it is the only kind of tie between its ends' surroundings
    sure = scored.where(F.col("s") >= 2)
    core = star_clusters(profs.select("case_id", "id", "copies"), sure)
    # rows known by initials alone join the one cluster that they fit
    ends = scored.where(F.col("s") < 2)
    weak = ends.select("case_id", F.col("a").alias("id"), F.col("b").alias("to")).unionByName(ends.select("case_id", F.col("b").alias("id"), F.col("a").alias("to")))
    counted = core.join(profs.select("case_id", "id", "copies"), ["case_id", "id"])
    sizes = counted.groupBy("case_id", "center").agg(F.sum("copies").alias("size"))
    at = core.join(sizes, ["case_id", "center"])
    lone = at.where(F.col("size") == 1).select("case_id", "id")
    fits = weak.join(lone, ["case_id", "id"]).join(at.select("case_id", F.col("id").alias("to"), F.col("center").alias("home"), "size"), ["case_id", "to"])
    votes = fits.groupBy("case_id", "id", "home").agg(F.count("*").alias("n"), F.max("size").alias("size"))
    one = Window.partitionBy("case_id", "id")
    per = votes.withColumn("homes", F.count("*").over(one)).withColumn("large", F.sum((F.col("size") > 1).cast("int")).over(one))
    pick = per.where((F.col("homes") == 1) | ((F.col("large") == 1) & (F.col("size") > 1))).select("case_id", "id", "home")
    # two lone rows may pick each other: the smaller id of the two is the centre
    back = pick.select("case_id", F.col("id").alias("home"), F.col("home").alias("back"))
    moved = pick.join(back, ["case_id", "home"], "left").withColumn("center2", F.when(F.col("back").isNull(), F.col("home")).when(F.col("back") == F.col("id"), F.least("id", "home")).otherwise(F.col("back")))
    out = core.join(moved.select("case_id", "id", "center2"), ["case_id", "id"], "left").select("case_id", "id", F.coalesce("center2", "center").alias("center"))
    return profs, materialize(out), stands


def _members(clusters: DataFrame, stands: DataFrame) -> DataFrame:
    """(case_id, entity_no, id, party_no): every entity row with the row that stands for it and the smallest of its party."""
    heads = clusters.groupBy("case_id", "center").agg(F.min("id").alias("party_no"))
    return stands.join(clusters.join(heads, ["case_id", "center"]).select("case_id", "id", "party_no"), ["case_id", "id"])


def party_members(entities: DataFrame) -> DataFrame:
    """One row per entity: (case_id, entity_no, party_no, links), party_no being the smallest entity_no of its party, links the number of its other rows."""
    _, clusters, stands = _clustered(entities)
    members = materialize(_members(clusters, stands).select("case_id", "entity_no", "party_no"))
    sizes = members.groupBy("party_no").agg((F.count("*") - 1).alias("links"))
    return salted_join(members, sizes, ["party_no"], salt_on=F.col("entity_no")).select("case_id", "entity_no", "party_no", "links")


def party_pairs(entities: DataFrame, calls: DataFrame) -> DataFrame:
    """(src, left_id, right_id): pairs of entity rows of one party, and calls with the first row of the caller's party.

    Rows without id or case, and names that are null or empty, match nothing. Entity rows that tell the
    same, and exact copies of a caller's name in a case, are compared once; pairs are formed only inside a
    party, spread over salts.
    """
    profs, clusters, stands = _clustered(entities)
    members = materialize(_members(clusters, stands))
    homes = members.select("case_id", "id", "party_no").distinct()
    right = members.select("party_no", F.col("entity_no").alias("right_id"))
    pairs = salted_join(members.select("party_no", F.col("entity_no").alias("left_id")), right, ["party_no"], salt_on=F.col("left_id"))
    pairs = pairs.where(F.col("left_id") < F.col("right_id")).select(F.lit("entities").alias("src"), "left_id", "right_id")
    named = calls.where(F.col("name").isNotNull() & (F.trim("name") != "") & F.col("case_id").isNotNull())
    named = named.join(profs.select("case_id").distinct(), "case_id", "left_semi")
    forms = named.groupBy("case_id", "name").agg(F.min("call_id").alias("id"))
    rows = forms.select("case_id", F.lit(1).alias("kind"), "id", F.array("name").alias("names"), F.lit(None).cast("array<string>").alias("emails"))
    callers = materialize(_profiles(rows))
    scored = _scored(_candidates(callers, profs, False), callers, profs)
    votes = scored.join(homes.select("case_id", F.col("id").alias("b"), "party_no"), ["case_id", "b"])
    per = votes.groupBy("case_id", F.col("a").alias("id"), "party_no").agg(F.max("s").alias("s"), F.count("*").alias("n"), F.sum("s").alias("w"))
    w = Window.partitionBy("case_id", "id").orderBy(F.desc("s"), F.desc("w"), "party_no")
    ranked = per.withColumn("rank", F.row_number().over(w)).withColumn("next", F.lead("s").over(w))
    best = ranked.where((F.col("rank") == 1) & ((F.col("s") >= 2) | F.col("next").isNull())).select("case_id", "id", "party_no")
    linked = forms.join(best, ["case_id", "id"]).select("case_id", "name", "party_no")
    spoken = named.join(linked, ["case_id", "name"]).select(F.lit("call_log").alias("src"), F.col("call_id").alias("left_id"), F.col("party_no").alias("right_id"))
    return pairs.unionByName(spoken)
