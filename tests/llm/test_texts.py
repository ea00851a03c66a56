import os
import random

import pytest

from larder.llm import packing, personal, tokenization as tk

HAVE = os.path.isdir(tk.TOKENIZERS)
needs = pytest.mark.skipif(not HAVE, reason="no tokenizers")


@needs
def test_encoding_equals_the_public_tokenizer():
    tiktoken = pytest.importorskip("tiktoken")
    ranks = tk.load_ranks("byte_bpe_50k")
    ref = tiktoken.Encoding("t", pat_str=tk.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(1)
    alphabet = "abcdeiou  aãéñ😀中́日'st\n\t0129.,-"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(0, 80))) for _ in range(1500)] + ["a" * 3000, " " * 700, "ção" * 500, "<|endoftext|>", "\u0000"]
    enc = tk.TrieEncoder(ranks, max_nodes=2000)
    got = [ids for i in range(0, len(texts), 100) for ids in enc.encode_batch(texts[i : i + 100])]
    assert got == [ref.encode_ordinary(t) for t in texts]
    assert b"".join(enc.bytes_of[i] for i in got[3]).decode() == texts[3]


@needs
def test_encoding_column(spark):
    df = spark.createDataFrame([(1, "bolo de milho", "x"), (2, None, "y"), (3, "", "z")], "id long, text string, ids string")
    got = {r.id: r.ids for r in tk.encode(df, "text").collect()}
    assert len(got[1]) >= 3 and got[2] == [] and got[3] == []
    assert {r.id: r.n_tokens for r in tk.token_counts(df, "text").collect()} == {i: len(v) for i, v in got.items()}


def test_plan_uses_everything_and_fills():
    rng = random.Random(3)
    for capacity in (10, 64):
        hist = {n: rng.randrange(0, 40) for n in range(1, capacity + 1)}
        left = dict(hist)
        bins = 0
        for p in packing.plan(hist, capacity):
            assert sum(n * k for n, k in p.times.items()) <= capacity
            for n, k in p.times.items():
                left[n] -= k * p.repeats
            bins += p.repeats
        assert not any(left.values())
        # Never worse than first fit on falling sizes.
        first_fit: list[int] = []
        for n in sorted((n for n, c in hist.items() for _ in range(c)), reverse=True):
            at = next((i for i, b in enumerate(first_fit) if b + n <= capacity), None)
            if at is None:
                first_fit.append(n)
            else:
                first_fit[at] += n
        assert bins <= len(first_fit)
    assert packing.plan({}, 5) == [] and packing.fullest([4, 3], {4: 1, 3: 2}, 6) == {3: 2}


def test_pack(spark):
    rng = random.Random(8)
    rows = [(i, rng.choice([0, 1, 3, 7, 7, 7, 7, 12, 25, None]), "c") for i in range(400)]
    df = spark.createDataFrame(rows, "doc long, n int, length string")
    got = packing.pack(df, "doc", "n", 10).collect()
    per, whole = {}, {}
    for r in got:
        per[r.container] = per.get(r.container, 0) + r.length
        whole[r.item] = whole.get(r.item, 0) + r.length
    assert max(per.values()) <= 10 and whole == {i: n or 0 for i, n, _ in rows}
    assert {r.item for r in got if r.piece > 0} == {i for i, n, _ in rows if (n or 0) > 10}
    assert sorted(per) == list(range(max(per) + 1))
    assert packing.pack(df.limit(0), "doc", "n", 10).count() == 0
    with pytest.raises(ValueError):
        packing.pack(df, "doc", "n", 0)


GIVEN = ["Célia", "Rute", "Heitor", "Oliva", "Raul", "Yara", "Abel", "Clara", "Rosa"]
SURNAMES = ["Napiez", "Vubodro", "Lacilez", "Zacheski", "Quanotti", "Pravenque", "Loguez", "Tremelra", "Bojerl", "Fanetti"]


def corpus():
    texts, truth = [], []
    rng = random.Random(5)
    for i in range(120):
        name = f"{rng.choice(GIVEN if i % 5 else ['Leopoldina', 'Tavico'])} {rng.choice(SURNAMES)}"
        frame = ["Meu nome é {} e moro aqui.", "Ligue para {} no (70) 9 1043-8593 depois.", "Créditos: {}.\nFicou bom.", "Enviado por {} <a.b+c{}@x.example>."][i % 4]
        text = frame.format(name, i)
        texts.append((i, text))
        at = text.index(name)
        truth.append((i, "NAME", at, at + len(name)))
    texts += [(500 + i, "😋 A Oliva Verde do jardim serve para decorar. A Rosa Branca também.") for i in range(30)]
    texts += [(600 + i, f"O código do pacote é 000890358617{i % 10}, lote 2025.890.{100 + i}.") for i in range(30)]
    return texts, truth


def test_found(spark):
    texts, truth = corpus()
    extra = [(900, "😋😋 RG 329.306.742-35 e Rua Doutor Napiez, n. 231-B, apto 2, às 971 Gojespira St. ou r@b.example.com e vi @perfil em 05/01/2025"), (901, None), (902, ""), (903, "  "), (904, "x " * 20000)]
    df = spark.createDataFrame([(a, t, "k") for a, t in texts + extra], "doc long, text string, kind string")
    names = spark.createDataFrame([(g,) for g in GIVEN] + [(None,)], "given string")
    got = {tuple(r) for r in personal.found(df, "doc", "text", names, "given").collect()}
    found_names = {g for g in got if g[1] == "NAME"}
    assert found_names == set(truth)
    assert not [g for g in got if 500 <= g[0] < 700]
    by = {g[1]: dict(texts + extra)[900][g[2] : g[3]] for g in got if g[0] == 900}
    assert by == {"ID": "329.306.742-35", "ADDRESS": by["ADDRESS"], "EMAIL": "r@b.example.com"}
    assert {dict(texts + extra)[900][g[2] : g[3]] for g in got if g[0] == 900 and g[1] == "ADDRESS"} == {"Rua Doutor Napiez, n. 231-B", "971 Gojespira St."}
    assert {t[g[2] : g[3]] for g in got if g[1] == "PHONE" for i, t in texts if i == g[0]} == {"(70) 9 1043-8593"}
    red = {r.doc: r for r in personal.redact(df, "doc", "text", personal.found(df, "doc", "text", names, "given")).collect()}
    assert red[1].redacted == "Ligue para [NAME] no [PHONE] depois." and red[901].redacted is None and red[902].redacted == ""
    assert personal.found(df.limit(0), "doc", "text", names, "given").count() == 0


@pytest.mark.parametrize("text,kinds", [
    ("a (arroba) b.com.example", ["EMAIL"]), ("a.b [at] c [dot] example", ["EMAIL"]), ("a&#64;b.example", ["EMAIL"]), ("x @ y.example", ["EMAIL"]), ("vi no @perfil hoje", []), ("em https://a.b/c@d.example/1", []),
    ("fone +55 (20) 96037 9735", ["PHONE"]), ("id QQ 47 56 88 C", ["ID"]), ("id 666-77-9071", ["ID"]), ("dni 71780149-A", ["ID"]), ("em 2025-09-03 custa R$ 1.592,00", []), ("Rua das Flores", []), ("bata aveia em flocos por 44 minutos", [])])
def test_shapes(text, kinds):
    assert [k for k, _, _ in personal.spans(text)[0]] == kinds


def test_numbers_follow_their_patterns(spark):
    """Numbers in no telling shape are what seeds behind the same words are; a pattern no seed follows says they are nothing."""
    rows = [(i, f"Ligue no (80) 9{i:04d}-12{i % 90 + 10} hoje.") for i in range(30)]
    rows += [(100 + i, f"Bom bolo. Ligue no 80.9{i:04d}.77{i % 90 + 10} hoje.") for i in range(20)]
    rows += [(200 + i, f"Receita nº 2025.{i + 100}.{i + 300} do caderno.") for i in range(30)]
    # A seed's shape in a place that many others show to be no telephone's.
    rows += [(300, "Receita nº 9123.4567.899 do caderno."), (301, "Receita nº 92345-6789 do caderno.")]
    df = spark.createDataFrame(rows, "doc long, text string")
    got = {(r.doc, r.kind) for r in personal.found(df, "doc", "text", spark.createDataFrame([("Ana",)], "g string"), "g").collect()}
    assert got == {(i, "PHONE") for i in range(30)} | {(100 + i, "PHONE") for i in range(20)}


def test_places_follow_their_patterns(spark):
    rows = [(i, f"Entregamos na Rua {SURNAMES[i % 10]} {SURNAMES[i % 7]}, {i + 10}, apto 2.") for i in range(40)]
    rows += [(100, "Entregamos na Servidão Lopes Tal, 77, apto 9."), (101, "Vi a Servidão Lopes Tal 77 vezes."), (102, "Entregamos na avenida 7 de setembro 120, casa."), (103, "Use 2 Large Ginger Hill agora.")]
    df = spark.createDataFrame(rows, "doc long, text string")
    got = {(r.doc, dict(rows)[r.doc][r.start_char:r.end_char]) for r in personal.found(df, "doc", "text", spark.createDataFrame([("Ana",)], "g string"), "g").collect() if r.doc >= 100}
    assert got == {(100, "Servidão Lopes Tal, 77"), (102, "avenida 7 de setembro 120")}


def test_names_of_any_length_and_copies(spark):
    texts, _ = corpus()
    long = "Heitor " + " ".join(SURNAMES[:7])
    texts += [(800, f"Meu nome é {long} e moro aqui."), (801, "Meu nome é Célia Napiez e Raul Bojerl e moro aqui.")]
    # One text copied often, with a surname in lower case, makes no ordinary word of it.
    texts += [(1000 + i, "napiez. bojerl. zacheski.") for i in range(400)]
    df = spark.createDataFrame(texts, "doc long, text string")
    names = spark.createDataFrame([(g,) for g in GIVEN], "given string")
    got = [(r.doc, dict(texts)[r.doc][r.start_char:r.end_char]) for r in personal.found(df, "doc", "text", names, "given").collect() if r.kind == "NAME"]
    assert sorted(x for x in got if 800 <= x[0] < 900) == [(800, long), (801, "Célia Napiez"), (801, "Raul Bojerl")]
    assert not [x for x in got if x[0] >= 1000] and len([x for x in got if x[0] < 500]) == 120


@pytest.mark.parametrize("part", ["MARIA SOUZA SILVA ", "maria souza ", "joe.at.", "Rua A B C D E F 9 ", "1 2 3 4 5 6 ", "a@b.example 11 91234-5678 "])
def test_work_is_linear_in_the_text(part):
    import time

    def seconds(n):
        began = time.perf_counter()
        personal.candidates(part * n, frozenset(["maria"]))
        return time.perf_counter() - began

    seconds(100)
    assert seconds(16000) < 10 * seconds(4000) + 0.2


def test_one_length_in_many_buckets(spark, monkeypatch):
    monkeypatch.setattr(packing, "BUCKETS", 1)
    monkeypatch.setattr(packing, "BUCKET_ROWS", 10)
    df = spark.createDataFrame([(i, 3) for i in range(200)], "doc long, n int")
    got = [r.container for r in packing.pack(df, "doc", "n", 10).collect()]
    assert sorted(got) == sorted([c for c in range(66) for _ in range(3)] + [66] * 2)


def test_too_many_capacities(spark, tmp_path):
    from larder.llm import queries

    root = str(tmp_path)
    spark.createDataFrame([(i, "byte_bpe_50k", i + 1) for i in range(queries.MAX_CAPACITIES + 1)], "capacity_id int, tokenizer string, capacity_tokens int").write.parquet(f"{root}/pack_capacities.parquet")
    with pytest.raises(ValueError):
        queries.p8_containers(spark, root)
