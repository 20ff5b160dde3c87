import numpy as np
import pytest

from squallframe.llm import encoding_repair as E

CLEAN = [
    "Es ist größer als früher, die Böen über München — schön.", "La célula bajó rápidamente; señal número 7 después del máximo.", "L’écart atteint 0.5, où la grille était trop grossière.",
    "Граница оттока была найдена поздно перед максимумом.", "線状の降水帯が急に発達した。レーダー確認済み。", "It’s clear that λ≈0.5 → 12 °C ± 3 km² ✓", "A região não cresceu, à direita: São três peças.", "Is it over? Yes. Was it? No.", "Runs +A12- and +K44- agree at Å scale.",
]


@pytest.fixture(scope="module")
def repairer():
    r = np.random.default_rng(0)
    texts = [" ".join(CLEAN[k] for k in r.permutation(len(CLEAN))) for _ in range(300)]
    pairs, chars, codes = np.zeros(E.PAIRS, np.int64), np.zeros(E.CHARS, np.int64), np.zeros(E.PAIRS, np.int64)
    E.tally([*texts, *(c for c in CLEAN for _ in range(100))], pairs, chars, codes)
    return E.Repairer(E.PairModel.of_counts(pairs, chars, codes))


def test_the_bound_splits_the_pairs(repairer):
    met = repairer.model.bits > repairer.model.bits.min()
    assert (repairer.model.weight[met] > 0).any() and (repairer.model.weight[met] < 0).any()
    assert (repairer.model.weight[~met] == E.MOST).all()


def test_runs_leave_most_sound_text_out(repairer):
    total = inside = 0
    for t in CLEAN:
        p = f"\n{t}\n"
        cps = E.code_points(p)
        w = repairer.weights(p, cps)
        beyond = (cps[:-1] > 127) | (cps[1:] > 127)
        covered = np.zeros(len(w), bool)
        for i, j in E.segments(w):
            covered[i:j] = True
        total, inside = total + beyond.sum(), inside + (beyond & covered).sum()
    assert inside < 0.25 * total


def test_nothing_outside_the_runs_is_mapped(repairer, monkeypatch):
    bad = CLEAN[1].encode().decode("cp1252")
    assert repairer.check(bad)
    monkeypatch.setattr(E.Repairer, "runs", staticmethod(lambda w, c: []))
    assert repairer.check(bad) is None and repairer.check(bad + "\ufffd") is None


def test_question_marks_in_any_number_are_examined(repairer):
    assert repairer._lost("e ????? d") == repairer._lost("e ????? d") and len(E._LOST.findall("a ????? b")) == 1
    assert repairer.check("Is it??? Yes") is None or repairer.check("Is it??? Yes").kind == "lost"


@pytest.mark.parametrize("text", ["\ufffd", 'It prints "\ufffd" where "\u00b0" stood', "\u201c\ufffd\u201d"])
def test_quoted_replacement_characters_are_talk(repairer, text):
    assert repairer.check(text) is None


@pytest.mark.parametrize("text", [*CLEAN, "", None, " ", "plain ascii", "a?b ok?", 'The legend prints "Ã¼" where "ü" was meant.', "T=3 &deg;C &gt; 2", "x" * 100_000, "╔══╗ ░░"])
def test_sound_texts(repairer, text):
    assert repairer.check(text) is None


@pytest.mark.parametrize("page", ["cp1252", "latin-1", "cp437", "cp850", "mac-roman", "cp1251", "cp1250"])
@pytest.mark.parametrize("k", range(4))
def test_utf8_read_as_a_page(repairer, page, k):
    bad = "".join(E.page_chars(page)[b] for b in CLEAN[k].encode())
    got = repairer.check(bad)
    assert got is not None and got.text == CLEAN[k]


def test_twice_lowered_and_escaped(repairer):
    once = CLEAN[1].encode().decode("cp1252")
    assert repairer.check("".join(E.page_chars("cp1252")[b] for b in once.encode())).text == CLEAN[1]
    assert repairer.check(once.lower()).text == CLEAN[1].lower()
    assert repairer.check("die B&Atilde;&para;en &Atilde;&frac14;ber").text == "die Böen über"


@pytest.mark.parametrize("meant,shown,k", [("cp1251", "latin-1", 3), ("koi8-r", "cp1251", 3), ("cp866", "cp1251", 3), ("cp1252", "cp850", 1), ("mac-roman", "cp1252", 1)])
def test_one_page_read_as_another(repairer, meant, shown, k):
    bad = "".join(E.page_chars(shown)[b] for b in CLEAN[k].encode(meant))
    assert repairer.check(bad).text == CLEAN[k]


def test_japanese_and_wide_and_utf7(repairer):
    t = CLEAN[4]
    assert repairer.check("".join(E.page_chars("latin-1")[b] for b in t.encode("cp932"))).text == t
    assert repairer.check(t.encode("euc_jp").decode("cp932", "replace")) is not None
    assert repairer.check(CLEAN[0].encode("utf-16-le").decode("latin-1")).text == CLEAN[0]
    assert repairer.check(CLEAN[5].encode("utf-16-be").decode("utf-16-le")) is not None
    assert repairer.check(CLEAN[5].encode("utf-7").decode("ascii")) is not None


def test_lossy_damage_is_found(repairer):
    assert repairer.check(CLEAN[1].encode("cp1252").decode("utf-8", "replace")).kind == "lost"
    assert repairer.check("It?s clear that ??0.5 ? 12 km? ±").kind
    assert repairer.check('prints "�" where') is None


def test_part_of_a_text(repairer):
    bad = CLEAN[2] + "\n" + CLEAN[1].encode().decode("cp1252") + "\n" + CLEAN[3]
    assert repairer.check(bad).text == CLEAN[2] + "\n" + CLEAN[1] + "\n" + CLEAN[3]


def test_segments_are_maximal():
    s = np.array([1, -0.5, 1, -3, 2, 2, -1, 0.5, -0.2])
    assert E.segments(s) == [(0, 3), (4, 6), (7, 8)]
    assert E.segments(np.array([])) == [] and E.segments(np.array([-1.0, -2.0])) == []


def test_frames(spark):
    rows = [(i, f"{t} #{i}", "clash") for i, t in enumerate(CLEAN * 40)] + [(9001, CLEAN[1].encode().decode("cp1252"), "x")] * 2 + [(9002, None, "x"), (9003, "", "x"), (9004, "  ", "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, kind string").repartition(3)
    got = E.find_damage(df, E.count_pairs(df)).collect()
    assert [r.doc_id for r in got] == [9001, 9001] and {r.restored for r in got} == {CLEAN[1]}
    empty = df.limit(0)
    assert E.find_damage(empty, E.count_pairs(empty)).count() == 0


def test_copies_do_not_become_the_norm(spark):
    rows = [(i, f"{t} #{i}") for i, t in enumerate(CLEAN * 20)] + [(10_000 + i, CLEAN[1].encode().decode("cp1252")) for i in range(100)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(2)
    assert E.find_damage(df, E.count_pairs(df)).count() == 100


def test_counts_do_not_depend_on_the_partitioning(spark):
    rows = [(i, t) for i, t in enumerate([*CLEAN, None, "", "x" * 50_000] * 7)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    a, b = E.count_pairs(df.repartition(1)), E.count_pairs(df.repartition(9))
    assert (a.bits == b.bits).all() and (a.single == b.single).all() and (a.weight == b.weight).all() and a.frequent == b.frequent
    assert sorted(r.text for r in E.single_copies(df).collect()) == sorted([*CLEAN, "x" * 50_000])


def test_lost_signs_have_no_restored_text(repairer):
    got = repairer.check(CLEAN[1].encode("cp1252").decode("utf-8", "replace"))
    assert got.kind == "lost" and got.text is None
