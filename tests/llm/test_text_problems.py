import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from papersieve.llm import langid, lookalikes, personal, scans, sentences, verbatim, winnow

# Problem 7


@pytest.mark.parametrize(
    "text, want",
    [
        ("Dr. Lee met Prof. Kim. They left.", ["Dr. Lee met Prof. Kim.", "They left."]),
        ('The officer said, "We stopped at 5 p.m. because of it." It worked!', ['The officer said, "We stopped at 5 p.m. because of it."', "It worked!"]),
        ("Am 21. Juni 2000 begann der 2. Durchgang. Vgl. Abb. 9, S. 14 ff. zu Bonn.", ["Am 21. Juni 2000 begann der 2. Durchgang.", "Vgl. Abb. 9, S. 14 ff. zu Bonn."]),
        ("彼らは「電力計は続く。問題はない。」と述べた。値は46.4であった。", ["彼らは「電力計は続く。問題はない。」と述べた。", "値は46.4であった。"]),
        ("« Est-ce utile ? » demanda la directrice. Oui.", ["« Est-ce utile ? » demanda la directrice.", "Oui."]),
        ("3. Results\nThe price rose to 2.5 units\nin May. See no.\n12 of the log.", ["3. Results", "The price rose to 2.5 units\nin May.", "See no.\n12 of the log."]),
        ("", []), (None, []), ("   \n\n ", []),
    ],
)
def test_sentences(text, want):
    assert [text[a:b] for a, b in sentences.sentence_spans(text)] == want


@settings(max_examples=150, deadline=None)
@given(st.text("aB .?!\n\"()“”。1", max_size=80))
def test_sentences_cover_all_but_blanks(text):
    spans = sentences.sentence_spans(text)
    assert all(a < b for a, b in spans) and all(spans[i][1] <= spans[i + 1][0] for i in range(len(spans) - 1))
    inside = set().union(*[range(a, b) for a, b in spans]) if spans else set()
    assert all(text[i].isspace() for i in range(len(text)) if i not in inside)


def test_split_frame_nulls_and_repeats(spark):
    df = spark.createDataFrame([(1, "One here. Two there.", 0), (1, "One here. Two there.", 1), (2, None, 0), (3, "", 0)], "id long, t string, sentence int")
    got = sentences.split_sentences(df, "id", "t").distinct().collect()
    assert sorted((r.id, r.sentence) for r in got) == [(1, "One here."), (1, "Two there.")]
    assert sentences.split_sentences(df.limit(0), "id", "t").count() == 0


# Problem 6


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from(list("abcА еоΑο ﬁｆ１ (é́​­  \n-‐²ｶﾞかのд")), max_size=30))
def test_canonical_by_segments(text):
    c = lookalikes.canonical(text)
    assert c == lookalikes.canonical_full(text)
    assert lookalikes.canonical(c) == c


@pytest.mark.parametrize("text, want", [("a\xa0\xa0a", "a a"), ("\xa0é\xa0\u3000\xa0b\xa0", "é b"), ("x\u2009\xa0у", "x y"), ("а\x1c b", "a\x1c b")])
def test_canonical_of_blanks_that_are_unstable(text, want):
    assert lookalikes.canonical(text) == lookalikes.canonical_full(text) == want


def test_canonical_keeps_what_looks_different():
    assert lookalikes.canonical("Аdарtіvе​ ｗｉｄｅ ofﬁce") == "Adaptive wide office"
    assert lookalikes.canonical("x²") == "x²" and lookalikes.canonical("Москва") == "Москва" and lookalikes.canonical(None) is None


def test_same_look(spark):
    u = spark.createDataFrame([(1, "A long enough unit about nothing in particular here"), (2, "А long enough unit about nothing in particular here"), (2, "А long enough unit about nothing in particular here"), (3, "Short"), (4, None)], "unit_id long, raw string")
    s = spark.createDataFrame([(1, "Intro. A long enough unit about nothing in particular here. Sh​ort end."), (2, None)], "source_id long, raw string")
    form = lambda d: lookalikes.with_canonical(d.where("raw is not null"), "raw", "form")
    assert [tuple(r) for r in lookalikes.same_look_units(form(u)).collect()] == [("U1", "U2")]
    assert {tuple(r) for r in lookalikes.shown_in_sources(form(u), form(s)).collect()} == {("S1", "U2"), ("S1", "U3")}


# Problem 2


@settings(max_examples=100, deadline=None)
@given(st.text("ab", min_size=60, max_size=120), st.integers(0, 40), st.text("abc", max_size=30), st.text("abc", max_size=30))
def test_winnowing_guarantee(core, cut, left, right):
    shared = core[:60]
    a, b = left + shared, right + shared + left
    ha, hb = (set(winnow.anchors(x, 20, 41)[1].tolist()) for x in (a, b))
    assert ha & hb


def brute(recs, n):
    out = set()
    for a, x in recs.items():
        for b, y in recs.items():
            if a < b and any(x[i : i + n] in y for i in range(len(x) - n + 1)):
                out.add((a, b))
    return out


def test_verbatim_equals_brute_force(spark):
    r = random.Random(5)
    word = lambda n: "".join(r.choice("abcdefghij ") for _ in range(n))
    boiler, passage = word(150), word(230)
    recs = {f"S{i}": word(60) + boiler + word(70) for i in range(70)}  # a hot span below the threshold
    recs |= {f"X{i}": word(50) + passage[: 190 + 10 * i] + word(60) for i in range(5)}
    long = word(260)
    recs |= {f"Y{i}": word(20) + long + word(30) for i in range(60)}  # a hot span above it
    recs["Z1"] = recs["Z2"] = word(300)
    df = spark.createDataFrame([*recs.items(), ("Z1", recs["Z1"]), ("N", None), ("E", "")], "rec string, text string")
    got = {tuple(x) for x in verbatim.found(df).collect()}
    assert got == brute(recs, 200)
    share = {x.rec: x for x in verbatim.shares(df).collect()}
    assert share["Z1"].shared_part == 1.0 and share["S0"].shared_chars == 0 and share["N"].n_chars == 0 and share["Y3"].shared_chars >= 260


# Problem 4


def test_labels():
    assert [langid.label_code(x) for x in ("EN", " en", "en-IN", "mar", "Deutsch", "und", "", None)] == ["en", "en", "en", "mr", "de", None, None, None]


def test_network_learns_held_out():
    parts = {
        "en": ("The survey of the group shows that", "was measured with the method of", "and the price of the unit rose"), "de": ("Die Umfrage der Gruppe zeigt, dass", "wurde mit der Methode gemessen und", "der Preis ist für die Einheit gestiegen"),
        "hi": ("समूह के सर्वेक्षण से पता चलता है कि", "को विधि से मापा गया है और", "की कीमत में अंतर था"), "mr": ("गटाच्या सर्वेक्षणातून असे दिसते आहे की", "मध्ये पद्धत वापरली जात होती आणि", "ची किंमत वाढली नाही"),
    }
    r = random.Random(1)
    make = lambda k: " ".join(r.choice(parts[k]) + f" {r.randint(1, 999)}" for _ in range(3)) + "."
    net = langid.train([(k, make(k)) for k in parts for _ in range(120)])
    good = 0
    for k in parts:
        x = [make(k) for _ in range(20)]
        good += sum(s[0][2] == k for s in langid.segments_of_many(x, net) if s)
    assert good >= 76
    mixed = make("en") + " " + make("en") + "\n\n" + make("hi") + " " + make("hi")
    assert [s[2] for s in langid.segments_of(mixed, net)] == ["en", "hi"]
    assert langid.segments_of_many(["", "   "], net) == [[], []] or all(not s or s[0][4] == 0 for s in langid.segments_of_many(["", "   "], net))


def test_activations_in_small_batches(monkeypatch):
    net, sizes, act = langid.ByteNet(("a", "b")), [], langid.ByteNet._activations
    monkeypatch.setattr(langid.ByteNet, "_activations", lambda self, raw: sizes.append(len(raw)) or act(self, raw))
    r = random.Random(4)
    texts = ["".join(r.choices("abc déक।. ", k=r.randint(12, 300))) for _ in range(600)]
    many = net.sentence_probabilities(texts)
    assert max(sizes) <= 1 << 15 and len(many) == len(texts)
    assert np.allclose(many, np.concatenate([net.sentence_probabilities([t]) for t in texts]), atol=1e-5)


def test_first_places_of_maxima():
    net = langid.ByteNet(("a", "b"))
    x = np.random.default_rng(5).integers(97, 100, (40, langid.WINDOW)).astype(np.uint8)
    for k, n in enumerate((0, 1, 3, 4, 8, 9, 60, 127)):
        x[k, n:] = 0
    f, at = net._pool(x)
    z = net._activations(x.reshape(-1)).reshape(40, langid.WINDOW, -1)
    for j in range(z.shape[2]):
        w = langid.WIDTHS[j // langid.FILTERS]
        for k in range(40):
            n = max(0, max(1, int((x[k] != 0).sum())) - w) + 1
            assert at[k, j] == z[k, :n, j].argmax() and f[k, j] == max(z[k, :n, j].max(), 0)


# Problem 5


def test_scans_small(spark):
    body = ["We describe a long survey of the unit that holds the pri-", "ce of the market and the method of the group which was", "measured in the town. The results of the survey show that", "the price of the unit rose in the market of the town and", "the mcthod of the group was used for the survey of prices."]
    pages, rows = [], []
    for i in range(30):
        top = f"Annual Report of Field Studies\n[{i + 2}]\n"
        p1 = "\n".join(body)
        t = p1 + "\n\n" + top + p1.replace("mcthod", "method")
        rows.append((i, t, [0, len(p1) + 2]))
    df = spark.createDataFrame([*rows, (99, "", None)], "ext_id long, text string, starts array<int>").where("text <> ''").repartition(2)
    got = {tuple(r) for r in scans.found(df).where("ext_id = 3").collect()}
    assert (3, 6, "header") in got and (3, 7, "page_number") in got and (3, 0, "split_word") in got
    text = " ".join(r.text for r in scans.paragraphs(df).where("ext_id = 3").collect())
    assert "price of the market" in text and "Annual Report" not in text


def test_page_numbers():
    assert all(scans.is_page_number(x) for x in ("12", "- 7 -", "[9]", "Page 3", "p. 4", "3/10", "iv")) and not any(scans.is_page_number(x) for x in ("[9].", "In 1999", ""))


# Problem 10


@pytest.mark.parametrize(
    "text, want",
    [
        ("Write to a.b+c@mail.test or x1 [at] post [dot] org.", {("EMAIL", "a.b+c@mail.test"), ("EMAIL", "x1 [at] post [dot] org")}),
        ("See order no. 7439922551 and invoice 2551-122-4, ISBN 978-0-00-354445-1.", set()),
        ("Call +91 50437 27072 or (0528) 571965.", {("PHONE", "+91 50437 27072"), ("PHONE", "(0528) 571965")}),
        ("The student Yash Jagreran-Lin, registration X3252786, declares this.", {("NAME", "Yash Jagreran-Lin"), ("ID", "X3252786")}),
        ("I am grateful to Dr. Nandita Lim for checking.", {("NAME", "Nandita Lim")}),
        ("Correspondence: Edith Menk, Plot No. 56, Near Kav Temple, Lilpa - 086260.", {("NAME", "Edith Menk"), ("ADDRESS", "Plot No. 56, Near Kav Temple, Lilpa - 086260")}),
        ("", set()), (None, set()),
    ],
)
def test_personal(text, want):
    assert {(k, text[a:b]) for a, b, k in personal.spans(text)} == want


def test_placeholders_and_surrogates(spark):
    t = "Name: Edith Menk\nEmail: a@b.test\nThe student Edith Menk, registration X3252786, declares this."
    assert personal.placeholder_text(t) == "Name: [NAME 1]\nEmail: [EMAIL 1]\nThe student [NAME 1], registration [ID 1], declares this."
    df = spark.createDataFrame([(1, t), (2, t.replace("Menk", "Mohk")), (3, None), (4, "")], "doc_id long, text string")
    found = personal.items(df).distinct()
    s = personal.surrogates(found).collect()
    assert len({(r.pii_kind, r.surrogate) for r in s}) == len(s) == found.select("pii_kind", "pii_text").distinct().count()
    assert all(r.surrogate != r.pii_text for r in s)
    assert personal.surrogate("PHONE", "+91 50437 27072").startswith("+91 ") and len(personal.surrogate("ID", "X3252786")) == 8
