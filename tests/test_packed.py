import random
import re

import pytest

from strandloom.operators.packed import Model, _hash, split_packed, tokens, undecided, unwrap, values_of

RULE = re.compile(r'"(?:[^"]|"")*"|\'[^\']*\'|(?:[^\W_]|[():\-])+')


def plain(field):
    """The rule without dialects: quoted values, else runs of the allowed characters."""
    inside = unwrap(field)
    out = []
    for m in RULE.findall(field if inside is None else inside):
        v = m[1:-1].replace('""', '"') if m[0] == '"' else m[1:-1] if m[0] == "'" else m
        if v not in ("", "NA", "null", "-"):
            out.append(v)
    return out


CASES = {
    "a1, b2,c3": ["a1", "b2", "c3"],
    "a1;;b2;;c3;": ["a1", "b2", "c3"],
    'c("a1", "b 2", \'c;3\')': ["a1", "b 2", "c;3"],
    "c(a1, l(3)x, E(y)7-h)": ["a1", "l(3)x", "E(y)7-h"],
    "[a1 b2]": ["a1", "b2"],
    '{"a1", "b2"}': ["a1", "b2"],
    "l(3)boka143": ["l(3)boka143"],
    '"x ""y"" z", 12': ['x "y" z', "12"],
    "\"p 3'\", 'q \"r\" s'": ["p 3'", 'q "r" s'],
    "a1 / b2|c3\td4\r\ne5": ["a1", "b2", "c3", "d4", "e5"],
    "NA, a1, null, -, , a1": ["a1", "a1"],
    ", a1, b2": ["a1", "b2"],
    "  ": [],
    "": [],
    "NA": [],
}


def best(field, codes=None):
    """The values of the cheapest dialect."""
    _, quotes, _, _, found = Model(codes).cheapest(field)
    return values_of(found, quotes)


@pytest.mark.parametrize("field", CASES)
def test_cases(field):
    assert best(field) == CASES[field]
    assert plain(field) == CASES[field]


def test_generated_lists_follow_the_rule(spark, rows):
    rng = random.Random(5)
    names = [str(rng.randrange(30_000, 200_000)) for _ in range(300)] + [f"l(3)x{i}" for i in range(20)] + [f"E(z){i}-h" for i in range(9)]
    odd = ["tul, pe {}", "gus/mi{}", "zin|ka-{}", "ro {} 3'", 'wex "ty" {}', "bo;{}"]
    fields = []
    for i in range(400):
        genes = [rng.choice(names) if rng.random() < 0.93 else rng.choice(odd).format(rng.randrange(99)) for _ in range(rng.randrange(1, 40))]
        style = rng.choice(["none", '"', "'", "mixed"])

        def shown(g, style=style):
            quote = style if style in ('"', "'") else rng.choice(["", '"']) if style == "mixed" else ""
            if not re.fullmatch(r"(?:[^\W_]|[():\-])+", g):
                quote = '"' if "'" in g or not quote else quote
            return '"' + g.replace('"', '""') + '"' if quote == '"' else f"'{g}'" if quote == "'" else g

        marks = rng.choice([[", "], [","], [";"], ["|"], ["\t"], ["\n"], [" "], [" / "], [", ", "; ", "|"], [", "]])
        text = "".join((rng.choice(marks) if j else "") + shown(g) for j, g in enumerate(genes))
        wrap = rng.choice(["", "", "", "c(", "[", "{"])
        fields.append((i, f"{wrap}{text}{ {'c(': ')', '[': ']', '{': '}'}.get(wrap, '') }", genes))
    df = spark.createDataFrame([(i, f, "kept", 1) for i, f, _ in fields], "i int, f string, value string, cell int")
    got = {}
    for r in split_packed(df, "f", ["i"], "pos", "gene").orderBy("i", "pos").collect():
        got.setdefault(r["i"], []).append(r["gene"])
    for i, f, genes in fields:
        assert got.get(i, []) == plain(f) == genes, f


def test_nulls_long_fields_and_repeats(spark, rows):
    long = ", ".join(f"g{i}" for i in range(30_000))
    df = spark.createDataFrame([(1, None), (2, ""), (3, " "), (4, long), (5, "a1,a1"), (5, "a1,a1")], "i int, f string")
    got = split_packed(df, "f", ["i"])
    assert got.where("i = 4").count() == 30_000
    assert rows(got.where("i = 5"), "value_pos", "value") == [(1, "a1"), (1, "a1"), (2, "a1"), (2, "a1")]
    assert got.where("i < 4").count() == 0
    assert split_packed(df.limit(0), "f", ["i"]).collect() == []


def test_positions_and_dialects(spark, rows):
    df = spark.createDataFrame([(1, "a1;b2"), (None, "[a1,b2]")], "i int, f string")
    got = split_packed(df, "f", ["i"], dialect="d")
    assert rows(got, "i", "value_pos", "value") == [(1, 1, "a1"), (1, 2, "b2"), (None, 1, "a1"), (None, 2, "b2")]
    assert "; bare" in {r["d"] for r in got.collect()}


def test_tokens_keep_their_marks():
    assert tokens("'a b' c", None, "'")[0] == ["'a b'", "c"]
    assert tokens("a, b", ",", "")[0] == ["a", "b"]


# fields whose first dialect is wrong, with values that other fields have; without codes each is parsed otherwise
PLANTED = {
    "Abd B;Ubx;fork head": (["Abd B", "Ubx", "fork head"], ["Abd", "B", "Ubx", "fork", "head"]),
    "HLA(DRA)": (["HLA(DRA)"], ["DRA"]),
    "ab'cd;ef'gh": (["ab'cd", "ef'gh"], ["ab", "cd;ef", "gh"]),
}


@pytest.mark.parametrize("field", PLANTED)
def test_codes_decide_planted_fields(field):
    right, plain_ = PLANTED[field]
    assert best(field) == plain_ != right
    assert best(field, {_hash(v): 4.0 for v in right}) == right


def test_rare_codes_are_joined(spark, rows):
    """Codes beyond the broadcast decide as if they were in it."""
    fields = [*([f] for f in PLANTED), *([f'"{v}"'] for right, _ in PLANTED.values() for v in right for _ in range(30)), *([f"g{i % 90}, g{i % 89}, g{i % 83}"] for i in range(2000))]
    df = spark.createDataFrame([(i, f[0]) for i, f in enumerate(fields)], "i int, f string")
    all_ = rows(split_packed(df, "f", ["i"], dialect="d"))
    few = rows(split_packed(df, "f", ["i"], dialect="d", coded=10))
    none = rows(split_packed(df, "f", ["i"], dialect="d", coded=0))
    assert all_ == few == none
    got = {}
    for i, pos, v, _ in sorted(all_):
        got.setdefault(i, []).append(v)
    assert [got[i] for i in range(len(PLANTED))] == [right for right, _ in PLANTED.values()]


def test_undecided_fields_ask_for_their_values():
    upper, lower = Model({}), Model({}, 2.0)
    assert undecided("a1,b2,c3", upper, lower) is None
    assert _hash("Abd B") in undecided("Abd B;Ubx", upper, lower)
