import random

import pytest

from windloom.llm import encoding as E

SENTENCES = [
    "Die Höhenleitwerk erhöht den Wert um 4.2 Prozent, wenn die Böenlast größer ist.",
    "Für die Außenflügel ergibt sich bei mäßiger Böe ein Wert von 0.5, was über der Schätzung liegt.",
    "Le coefficient de traînée dépend de la forme choisie, et l’écart relevé près du sol reste inférieur à 1.2.",
    "Après 44 cycles, l’élément présentait une légère fissure — voilà « tout ».",
    "The façade balance at the Çelvan laboratory read 3.1 N ± 0.2 N, as the “Penvel” data show.",
    "The wing’s lift lies in the range 2.1–3.4; at α = 12° it isn’t far from 3 × 10⁻³.",
    "No está claro por qué la vibración de la sección cayó después del despegue.",
    "A secção central não perde sustentação até à última medição.",
]


def page(rng, n=12):
    return " ".join(rng.choice(SENTENCES) for _ in range(n))


def misread(text, true, read):
    out = ""
    for b in text.encode(true):
        try:
            out += bytes([b]).decode(read)
        except UnicodeDecodeError:
            out += chr(b)
    return out


@pytest.fixture(scope="module")
def model():
    rng = random.Random(0)
    counts = {}
    for k in range(400):
        t = page(rng)
        if k % 12 == 0:
            t = misread(t, "utf-8", rng.choice(["cp1252", "mac_roman"]))
        t = f" {t} "
        for i in range(1, len(t) - 1):
            if t[i] > "\x7f":
                key = (E.kind(t[i - 1]), t[i], E.kind(t[i + 1]))
                counts[key] = counts.get(key, 0) + 1
    return E.Model(counts)


@pytest.mark.parametrize("read", ["cp1252", "latin-1", "mac_roman", "cp437", "cp850", "cp1250", "cp1251"])
def test_utf8_misread_is_restored_exactly(model, read):
    rng = random.Random(1)
    for _ in range(20):
        text = page(rng)
        got, states, places = model.restore(misread(text, "utf-8", read))
        assert got == text and places > 0 and states


def test_partly_and_twice_misread(model):
    rng = random.Random(2)
    for _ in range(20):
        a, b, c = page(rng, 3), page(rng, 3), page(rng, 3)
        assert model.restore(a + " " + misread(b, "utf-8", "cp1252") + " " + c)[0] == f"{a} {b} {c}"
        twice = misread(misread(b, "utf-8", "cp1252"), "utf-8", "cp1252")
        assert model.restore(twice)[0] == b


def test_single_byte_pairs_and_gbk(model):
    text = SENTENCES[2] + " " + SENTENCES[3].replace("—", "-")
    for read in ("mac_roman", "cp1251"):
        keep = "".join(c for c in text if c not in "«»’")
        got, states, _ = model.restore(misread(keep, "cp1252", read))
        assert got == keep and states == [f"cp1252>{read}"]
    text = "Le déplacé a été élevé: la légère."
    assert model.restore(text.encode().decode("gbk", "replace"))[0] == text


def test_clean_texts_stay(model):
    rng = random.Random(3)
    others = ["Zażółć gęślą jaźń", "Привет, это текст", "λ √≈ ∑ ∫ ρ≤ √β ÷", " item", "naïve", "東京の翼 翼面", "Ångström Ørsted Łódź ő ű", "", "plain"]
    for text in [*others, *(page(rng) for _ in range(50))]:
        assert model.restore(text) == (text, [], 0)


def test_table_operator(spark):
    rng = random.Random(4)
    rows = [(i, page(rng), "x") for i in range(300)]
    wrong = {7: "cp1252", 8: "mac_roman", 9: "cp437"}
    rows = [(i, misread(t, "utf-8", wrong[i]) if i in wrong else t, x) for i, t, x in rows]
    lost = rows[20][1].encode("latin-1", "ignore").decode("utf-8", "replace")
    rows += [(500, None, "x"), (501, "", "x"), (502, "plain", "x"), (503, lost, "x"), rows[7]]
    docs = spark.createDataFrame(rows, "page_id long, text string, states string")
    got = E.repair_encoding(docs, "page_id", "text")
    assert sorted(r["page_id"] for r in got.collect()) == [7, 7, 8, 9, 503]
    assert sorted(r[0] for r in E.found_wrong(docs).collect()) == [7, 8, 9, 503]
    filled = {r["page_id"]: r["text"] for r in E.fill_lost(got, "page_id", docs, "text").collect()}
    assert "größer" in filled[503] or "é" in filled[503]
    assert E.repair_encoding(docs.limit(0), "page_id", "text").count() == 0


def counted(texts):
    counts = {}
    for t in (f" {t} " for t in texts):
        for i in range(1, len(t) - 1):
            if t[i] > "\x7f":
                key = (E.kind(t[i - 1]), t[i], E.kind(t[i + 1]))
                counts[key] = counts.get(key, 0) + 1
    return counts


def test_single_signs_in_any_setting_are_found(spark):
    rng = random.Random(5)
    clean = [f"{page(rng)} {'Der Wert ist in grö- ' + chr(10) + 'ßerer Höhe klein. ' if k % 100 == 0 else ''}At 12° the lift is 2 – 3 – 4 – 5 times the drag. Für die Höhe, natürlich erklärt." for k in range(300)]
    wrong = {1000: ("At 68.15° the control power", "mac_roman"), 1001: ("The drag – more than", "mac_roman"), 1002: ("Für die Mühe natürlich erklärt, für die Wände", "cp850")}
    rows = [*enumerate(clean), *((i, misread(t, "cp1252", r)) for i, (t, r) in wrong.items())]
    docs = spark.createDataFrame(rows, "page_id long, text string")
    got = {r["page_id"]: r["text"] for r in E.repair_encoding(docs, "page_id", "text", counted(t for _, t in rows)).collect()}
    assert got == {i: t for i, (t, _) in wrong.items()}


def test_states_without_enough_evidence_are_the_ones_left_out(model):
    rng = random.Random(6)
    signs = "Ââ€™Ã¤ \u00a0÷³õ∞ñ·é漢鎴\ufffdаaA0.-\x1c\n"
    for _ in range(2000):
        text = "".join(rng.choice(signs) for _ in range(rng.randint(1, 30)))
        evidence = [0.0] * len(model.states)
        for state, s, e, d in model.candidates(text):
            evidence[state] += max(model.odds(text, s, e, d, state), 0.0)
        evidence[-1] = E.LOST_WEIGHT * text.count(E.LOST)
        assert model.live(text) == [k for k, v in enumerate(evidence) if v + model.enter[k] + E.LEAVE > 0]


def test_damage_in_many_layers_is_undone():
    counts = {("s", "é", "l"): 500, ("l", "é", "l"): 900, ("l", "é", "s"): 800, ("l", "ü", "l"): 300}
    text = "The élan of café users who préfer brûlée"
    damaged = text
    for _ in range(4):
        damaged = damaged.encode("utf-8").decode("latin-1")
    model = E.Model(counts)
    assert len(model.restore(damaged)[0]) < len(damaged) and model.restore(text)[0] == text
