from fractions import Fraction

import pytest

from larder.operators import units as U

F_ = {"g": ("mg", Fraction(1000)), "kg": ("mg", Fraction(10**6)), "mg": ("mg", Fraction(1)), "oz": ("mg", Fraction(28350)), "lb": ("mg", Fraction(453592)), "ml": ("ul", Fraction(1000)),
      "l": ("ul", Fraction(10**6)), "dl": ("ul", Fraction(10**5)), "cl": ("ul", Fraction(10**4)), "cup": ("ul", Fraction(240000)), "coffee_cup": ("ul", Fraction(50000)), "glass": ("ul", Fraction(200000)),
      "tbsp": ("ul", Fraction(15000)), "dsp": ("ul", Fraction(10000)), "tsp": ("ul", Fraction(5000)), "coffee_sp": ("ul", Fraction(2500)), "s": ("s", Fraction(1)), "min": ("s", Fraction(60)), "h": ("s", Fraction(3600)), "d": ("s", Fraction(86400))}


@pytest.mark.parametrize("line,want", [
    ("685 g. de farinha", ("mg", 685000)), ("3⅓ xíc. (chá) de castanha", ("ul", 800000)), ("2 e 1/2 colheres (de sopa) de mel", ("ul", 37500)), ("1.300 g de arroz", ("mg", 1300000)),
    ("1,5 kg", ("mg", 1500000)), ("2.5Kg de sal", ("mg", 2500000)), ("2 x 130 g de castanha", ("mg", 260000)), ("2 latas (395 g cada) de leite", ("mg", 790000)), ("2 pacotes de 425g de carne", ("mg", 850000)),
    ("3 kg e 400 g de queijo", ("mg", 3400000)), ("640 ou 725 g de açúcar", ("mg", 640000)), ("20-30 ml de rum", ("ul", 20000)), ("três xíc. (126 g) de leite", ("ul", 720000)), ("2 colheres (de sopa) e meia de orégano", ("ul", 37500)),
    ("meia lb de carne", ("mg", 226796)), ("leite (quatro xíc.)", ("ul", 960000)), ("1 c/ sopa de mel", ("ul", 15000)), ("mais ou menos 20 mL de leite", ("ul", 20000)), ("x&iacute;cara: 2 x&iacute;caras (café)", ("ul", 100000)),
    ("2/3 colher (chá) de sal", ("ul", 3333)), ("2 ovos", None), ("1 pitada de sal", None), ("leite com 3,5% de gordura", None), ("água a 40 °C", None), ("forma de 24 cm", None), ("massa descansada por 2 h", None), ("1 lata de milho", None), ("", None), (None, None)])
def test_kitchen(line, want):
    assert U.kitchen_amount(line, F_) == want


@pytest.mark.parametrize("text,want", [
    ("PT1H5M", 3900), ("03:10", 11400), ("1h45", 6300), ("uma hora e meia", 5400), ("1,5 h", 5400), ("¾ de hora", 2700), ("20 a 30 min", 1200), ("90 – 105 minutos", 5400), ("2 dias", 172800),
    ("preparo: 25min", 1500), ("35&nbsp;min", 2100), ("4200 s", 4200), ("3h e 45min", 13500), ("70 minutos + descanso", 4200), ("trinta minutos", 1800), ("rápido", None), ("N/D", None), ("", None), (None, None)])
def test_duration(text, want):
    got = U.duration_amount(text, F_)
    assert (got and got[1]) == want


def test_stated_rows(spark):
    ref = spark.createDataFrame([(k, b, float(f)) for k, (b, f) in F_.items()], "unit_code string, base_unit string, factor_to_base double")
    rows = spark.createDataFrame([("1", "2 kg de sal", "x"), ("1", "2 kg de sal", "x"), ("2", None, "y"), ("3", "ovos " * 5000, "z")], "id string, raw_text string, amount string")
    got = U.stated_amounts(rows, "raw_text", ref, "kitchen").collect()
    assert [(r.id, r.base_unit, r.amount) for r in got] == [("1", "mg", 2000000)] * 2
    assert U.stated_amounts(rows.limit(0), "raw_text", ref, "duration").count() == 0


def test_inferred_units(spark):
    stated = spark.createDataFrame([("flour", 500e3)] * 20 + [("yeast", 9e3)] * 20, "subject string, base_amount double")
    bare = spark.createDataFrame([("flour", 480.0), ("flour", 0.5), ("yeast", 10.0), ("yeast", None), ("new", 3.0)], "subject string, n double")
    got = {(r.subject, r.n): r for r in U.infer_units(bare, "subject", "n", stated, {"g": 1e3, "kg": 1e6}).collect()}
    assert got["flour", 480.0].unit == "g" and got["flour", 0.5].unit == "kg" and not got["flour", 480.0].uncertain
    assert got["yeast", 10.0].unit == "g" and got["yeast", None].unit is None and got["yeast", None].uncertain
    assert 0 < got["new", 3.0].posterior <= 1


def test_counts_stay_counts(spark):
    """Pieces are no measures, a dropped unit is recovered, and what may be either is flagged."""
    ref = spark.createDataFrame([(k, b, float(f)) for k, (b, f) in F_.items()], "unit_code string, base_unit string, factor_to_base double")
    lines = [f"{n} g de farinha de trigo" for n in (300, 350, 400, 500, 250)] * 8 + [f"{n} ml de leite integral" for n in (200, 250, 300, 150)] * 8 + ["1 oz de queijo", "2 xícaras de farinha"]
    bare = [("8 ovos amassado", "count"), ("½ cebola", "count"), ("duas bananas", "count"), ("3 a 4 dentes de alho", "count"), ("6 folhas de louro", "count"), ("2 cubos de caldo", "count"), ("1,5 limão", "count"),
            ("350 farinha", "g"), ("400 de farinha de trigo bem firme", "g"), ("250 leite", "ml"), ("200 sal", None), ("12", None)]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(lines + [t for t, _ in bare] * 3 + ["24 cm de papel", "água a 40 °C", "", "ovos"])] + [(9999, None)], "id long, raw_text string")
    read = U.amounts_and_numbers(rows, "raw_text", ref, "kitchen")
    assert read.where("amount IS NOT NULL").count() == len(lines)
    stated = read.where("amount IS NOT NULL").select("subject", "unit", "base_unit", read.amount.alias("base_amount"))
    numbers = read.where("number IS NOT NULL")
    assert numbers.count() == 3 * len(bare)
    candidates = {k: (b, float(f)) for k, (b, f) in F_.items() if k in U.KITCHEN}
    got = {r.raw_text: r for r in U.infer_units(numbers.drop("amount"), "subject", "number", stated, candidates, counts=True).collect()}
    for text, want in bare:
        if want:
            assert (got[text].unit, got[text].uncertain) == (want, False), (text, got[text])
    assert got["350 farinha"].base_amount == 350000 and got["350 farinha"].base_unit == "mg" and got["8 ovos amassado"].base_amount is None
    assert got["12"].uncertain and got["12"].subject is None and "200 sal" in got
    empty = numbers.limit(0)
    assert U.infer_units(empty, "subject", "number", stated.limit(0), candidates, counts=True).count() == 0


def test_bare_durations(spark):
    ref = spark.createDataFrame([(k, b, float(f)) for k, (b, f) in F_.items()], "unit_code string, base_unit string, factor_to_base double")
    rows = spark.createDataFrame([(i, t) for i, t in enumerate([f"{n} minutos" for n in range(20, 80)] + ["2 h", "1h30", "45", "50"])], "id long, t string")
    read = U.amounts_and_numbers(rows, "t", ref, "duration")
    stated = read.where("amount IS NOT NULL").select("subject", "unit", "base_unit", read.amount.alias("base_amount"))
    got = {r.t: (r.unit, r.uncertain) for r in U.infer_units(read.where("number IS NOT NULL"), "subject", "number", stated, {k: (F_[k][0], float(F_[k][1])) for k in U.TIME}).collect()}
    assert got == {"45": ("min", False), "50": ("min", False)}
