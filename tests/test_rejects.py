import json
import random

import pytest

from tidemark.operators.rejects import LEAST_TS, TS_END, StructuralIndex, read_json, read_lines, typed_records, valid_answer

HEAD = ["#separator \\x09", "#path\tdns", "#fields\tts\tuid\tquery\tanswers"]
TSV = [
    ("1730304846.889596\tC1\ta.example\t192.0.2.1,b.example", None),
    ("1730304846\tC1\ta.example\t-\r", None),
    ("1730304846\tC1\ta.example\t(empty)", None),
    ('1730304846\tC1\ta.example\t"v=spf1 -all, x","say ""hi"""', None),
    ('1730304846\tC1\ta.example\t"",plain', None),
    ("1730304846\tC1\ta.example", "column_count"),
    ("1730304846\tC1\ta.example\t-\t-", "column_count"),
    ('1730304846\tC1\ta.example\tx"y"', "quoting"),
    ('1730304846\tC1\ta.example\t"open,192.0.2.1', "quoting"),
    ('x\tC1\ta.example\t"a" ,b', "quoting"),
    ('1730304846\tC1\ta.example\t"a""', "quoting"),
    ("1730304846.\tC1\ta.example\t-", "bad_ts"),
    (" 1730304846\tC1\ta.example\t-", "bad_ts"),
    ("946684799\tC1\ta.example\t192.0.2.999", "bad_ts"),
    ("1730304846\tC1\ta.example\t", "bad_answers"),
    ("1730304846\tC1\ta.example\t192.0.2.1,,x", "bad_answers"),
    ("1730304846\tC1\ta.example\t192.0.2.256", "bad_answers"),
    ("1730304846\tC1\ta.example\t2001:db8:zz::1", "bad_answers"),
    ("1730304846\tC1\ta.example\ta..b", "bad_answers"),
]
NDJSON = [
    ('{"ts": 1730304846.5, "answers": ["a.example"]}', None),
    ('{"ts": 1730304846, "answers": null}', None),
    ('{"ts": 1730304846, "qtype_name": "TXT", "answers": ["", "a \\"b\\" {"]}', None),
    ('{"ts": 1730304846, "answers": [""]}', "bad_answers"),
    ('{"ts": 1730304846, "qtype_name": "TXT", "answers": [null]}', "bad_answers"),
    ('{"ts": 1730304846, "answers": "a"}', "bad_answers"),
    ('{"ts": "1730304846"}', "bad_ts"),
    ('{"ts": true}', "bad_ts"),
    ("{}", "bad_ts"),
    ('[{"ts": 1730304846}]', "json_syntax"),
    ('{"ts": 1730304846}}', "json_syntax"),
    ('{"ts": 1730304846, "a": "open}', "json_syntax"),
    ('{"ts": NaN}', "json_syntax"),
    ("   ", "json_syntax"),
]


def lines(spark, files):
    rows = [(f"{name}:{k}", name, k + 1, text) for name, texts in files.items() for k, text in enumerate(texts)]
    return spark.createDataFrame(rows, "line_id string, file_name string, line_no int, raw_line string").repartition(3)


def test_reasons(spark):
    df = lines(spark, {"t": HEAD + [x for x, _ in TSV] + ["", "\r", "#close"], "j": [x for x, _ in NDJSON]})
    got = {r.line_id: r.reason for r in read_lines(df).collect()}
    want = {f"t:{k + len(HEAD)}": r for k, (_, r) in enumerate(TSV)} | {f"j:{k}": r for k, (_, r) in enumerate(NDJSON)}
    assert {k: (got.get(k, "no data"), v) for k, v in want.items() if got.get(k, "no data") != v} == {}
    assert len(got) == len(want)


@pytest.mark.parametrize("block", [1, 2, 8192])
def test_headers_hold_until_the_next_in_any_block(spark, block):
    texts = ["1\t2", *HEAD, "1730304846\tC\tq\t-", "#separator \\x7c", "#fields|ts|answers", "1730304846|-", "1730304846\tC\tq\t-", "1730304846|x.y"]
    got = {r.line_id: r.reason for r in read_lines(lines(spark, {"f": texts}), block=block).collect()}
    assert got == {"f:0": "column_count", "f:4": None, "f:7": None, "f:8": "column_count", "f:9": None}


def test_records_and_odd_input(spark):
    df = lines(spark, {"t": HEAD + [TSV[3][0]], "j": ['{"ts": 1730304846.5, "id.orig_p": 53, "rejected": "T"}']})
    rows = {r.file_name: r for r in typed_records(read_lines(df)).collect()}
    assert rows["t"].answers == ["v=spf1 -all, x", 'say "hi"'] and rows["t"].query == "a.example" and rows["t"].ts == 1730304846
    assert rows["j"].orig_p == 53 and rows["j"].rejected is True and rows["j"].answers is None
    assert read_lines(df.limit(0)).count() == 0
    odd = spark.createDataFrame(
        [(1, None, None, "{}"), (2, "a", None, None), (3, "a", 1, "é" * 100_000)],
        "line_id int, file_name string, line_no int, raw_line string"
    ).selectExpr("*", "1 as reason", "2 as tsv", "3 as block")
    assert {r.line_id: r.reason for r in read_lines(odd).collect()} == {1: "bad_ts", 3: "json_syntax"}


def test_index_knows_escapes_and_answers():
    index = StructuralIndex([b'a\\"b"', b'"\\\\"'])
    assert index.quotes(True).nonzero()[0].tolist() == [4, 5, 8]
    assert index.ends.tolist() == [5, 9]
    assert [valid_answer(x) for x in (
        "1.2.3.4", "1.2.3", "010.1.1.1", "::1", "fe80::1%eth0", "a_b.c-d", "a.", "", "a b"
    )] == [True, False, True, True, False, True, False, False, False]


def by_parser(line):
    def no(name):
        raise ValueError(name)

    try:
        x = json.loads(line.strip(" \t\n\r"), parse_constant=no)
        if not isinstance(x, dict):
            raise ValueError
    except ValueError:
        return "json_syntax", None
    ts, a = x.get("ts"), x.get("answers")
    if isinstance(ts, bool) or not isinstance(ts, (int, float)) or not LEAST_TS <= ts < TS_END:
        return "bad_ts", None
    if a is not None and not (isinstance(a, list) and all(isinstance(v, str) for v in a) and (x.get("qtype_name") == "TXT" or all(map(
        valid_answer, a
    )))):
        return "bad_answers", None
    return None, a


def test_json_index_against_a_parser():
    draw = random.Random(1)
    atoms = [
        "{", "}", "[", "]", ":", ",", '"', "\\", '\\"', "\\\\", "\\u0041", "\\u00", "ts", '"ts"', '"answers"', '"TXT"',
        "1730304846", "1.5e9", "-0", "01", "true", "null", "NaN", " ", "\t", "\n", "é", '["a.b"]', '"\\u0074s"', "\x01", '""'
    ]
    values = [1730304846, 1.5e9, True, None, "TXT", 'x\\"y', ["a.b"], ["a.b", "1.2.3.999"], [], ["a", 1], {"ts": 1}, [["a"]], "é\n"]

    def line():
        if draw.random() < 0.3:
            return "".join(draw.choice(atoms) for _ in range(draw.randint(0, 12)))
        text = json.dumps(
            {draw.choice(["ts", "answers", "qtype_name", "a", 'b"c', "é"]): draw.choice(values) for _ in range(draw.randint(0, 5))},
            ensure_ascii=draw.random() < 0.5
        )
        k = draw.randrange(len(text) + 1)
        return text if draw.random() < 0.5 else text[:k] + draw.choice(atoms) + text[k + draw.randint(0, 2) :]

    for _ in range(60):
        lines = [line() for _ in range(draw.choice([1, 5, 100]))]
        assert list(zip(*read_json(lines))) == [by_parser(x) for x in lines]
    assert read_json([]) == ([], [])


def test_any_number_of_fields_and_repeated_ones(spark):
    wide = ["ts", *(f"f{k}" for k in range(1300)), "query"]
    df = lines(spark, {
        "wide": ["#fields\t" + "\t".join(wide), "\t".join(["1730304846", *"x" * 1300, "a.example"])],
        "twice": ["#fields\tts\tquery\tts\tquery", "1730304846\tfirst.example\t1\tsecond.example"],
        "whole": ["#fields\tts\tid.orig_p\torig_bytes", "1730304846\t443.0\t9007199254740993", "1730304846\tx\t1e3"],
    })
    rows = sorted(typed_records(read_lines(df)).collect(), key=lambda r: r.line_id)
    assert [(r.file_name, r.query, r.orig_p, r.orig_bytes) for r in rows] == [
        ("twice", "first.example", None, None), ("whole", None, 443, 9007199254740993), ("whole", None, None, 1000),
        ("wide", "a.example", None, None)
    ]
