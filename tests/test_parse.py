import datetime as dt
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from gridspark.operators.parse import explode_cells, parse_clean, parse_errors, split_lines

SCHEMA = "line_id bigint, file_name string, line_no int, line string, reason string, kind string"
OK = "QXC00000001,20200229,TMAX,12,,,N,0700"
STATION = "QXR00009975  37.8719  -93.7143   85.7 WENTONA RANCH"


def frame(spark, lines):
    return spark.createDataFrame([(i, f, i, x, "clash", "clash") for i, (f, x) in enumerate(lines)], SCHEMA)


def machine(line):
    """(fields, sound) by a character-wise state machine."""
    fields, cur, state, sound = [], "", "start", True
    for c in line:
        if state == "start" and c == '"':
            state = "in"
        elif state == "in":
            if c == '"':
                state = "after"
            else:
                cur += c
        elif state == "after":
            if c == '"':
                cur, state = cur + '"', "in"
            elif c == ",":
                fields.append(cur)
                cur, state = "", "start"
            else:
                sound, state = False, "plain"
                cur += c
        elif c == ",":
            fields.append(cur)
            cur, state = "", "start"
        else:
            sound &= c != '"'
            cur, state = cur + c, "plain"
    return [*fields, cur], sound and state != "in"


def reason(file, line):
    line = line or ""
    dec = lambda x: re.fullmatch(r"-?[0-9]+(\.[0-9]+)?", x.strip(" "))
    if file == "stations.txt":
        if len(line) < 30:
            return "columns"
        if not (dec(line[11:20]) and dec(line[20:30])):
            return "coordinates"
        return None if not line[30:37].strip(" ") or dec(line[30:37]) else "elev"
    fields, sound = machine(line)
    if not sound:
        return "quoting"
    if len(fields) != 8:
        return "columns"
    try:
        if not re.fullmatch("[0-9]{8}", fields[1]):
            return "date"
        dt.datetime.strptime(fields[1], "%Y%m%d")
    except ValueError:
        return "date"
    return None if dec(fields[3]) else "value"


CASES = [OK, "", None, OK.replace("12", ""), OK.replace("12", ' "12"'), OK.replace("12", '"1""2"'), OK.replace("12", '"12"'), OK.replace("12", "1.2.3"), OK.replace("12", " -9999 "), OK.replace("12", "nan"),
         OK.replace("20200229", "20210229"), OK.replace("20200229", "2020-02-29"), OK.replace("20200229", " 20200229"), OK.replace("0700", '"07,00"'), OK.replace("0700", '"07'), OK.replace("0700", '"07" x'),
         OK + ",", OK.replace(",", ";"), '"a",20200101,"x",1,,,,""', '"",20200101,"""q""",1,,,,', 'a"b,20200101,x,1,,,,', 'ab""c,20200101,x,1,,,,', '"' * 7, ",,,,,,,", "x" * 200_000, '"' + '""' * 50_000 + '",20200101,x,1,,,,', OK.replace("12", "5."), OK.replace("12", "+5")]
STATIONS = [STATION, STATION.replace(" 85.7", "     "), STATION[:29], STATION[:30], STATION.replace("37.8719", "37.8x19"), STATION.replace("85.7", "8S.7"), STATION.replace("  85.7", "-999.9"), "", "é" * 29]


def test_reasons(spark):
    lines = [("2020.csv", x) for x in CASES] + [(None, OK), (None, "x")] + [("stations.txt", x) for x in STATIONS]
    df = frame(spark, lines)
    got = {r["line_id"]: r["reason"] for r in parse_errors(df).collect()}
    assert got == {i: r for i, (f, x) in enumerate(lines) if (r := reason(f, x))}
    clean = parse_clean(df)
    assert sorted(r["line_id"] for r in clean.collect()) == [i for i in range(len(lines)) if i not in got]


def test_typed_rows(spark):
    r = {x["line_id"]: x for x in parse_clean(frame(spark, [("2020.csv", OK), ("stations.txt", STATION), ("2021.csv", '"a",20200101,"x"," 7 ",,,,"a ""b"", c"')])).collect()}
    assert r[0]["date"] == dt.date(2020, 2, 29) and r[0]["value"] == 12.0 and r[0]["mflag"] is None and r[0]["obs_time"] == "0700" and r[0]["lat"] is None
    assert (r[1]["station_id"], r[1]["lat"], r[1]["lon"], r[1]["elev"], r[1]["name"]) == ("QXR00009975", 37.8719, -93.7143, 85.7, "WENTONA RANCH")
    assert r[2]["value"] == 7.0 and r[2]["obs_time"] == 'a "b", c'


def test_null_ids_repeats_and_all_reasons(spark):
    rows = [(None, "a.csv", 1, OK, "", ""), (None, "a.csv", 2, "x", "", ""), (5, "a.csv", 3, OK.replace("12", "x").replace("20200229", "y"), "", ""), (5, "a.csv", 3, OK.replace("12", "x").replace("20200229", "y"), "", "")]
    df = spark.createDataFrame(rows, SCHEMA)
    e = {r["line_id"]: r for r in parse_errors(df).collect()}
    assert len(e) == 2 and e[None]["reason"] == "columns" and e[5]["reasons"] == ["date", "value"]
    assert parse_clean(df).count() == 1


@settings(max_examples=25, deadline=None)
@given(st.lists(st.text(alphabet='a,"1 ', max_size=12), min_size=1, max_size=20))
def test_quoting_like_a_state_machine(spark, lines):
    p = split_lines(frame(spark, [("x.csv", x) for x in lines]))
    cells = explode_cells(p).filter("column = '#quoting'").collect()
    sound = {r["line_id"]: r["value"] == "ok" for r in cells}
    fields = {r["line_id"]: r["fields"] for r in p.collect()}
    for i, x in enumerate(lines):
        want, ok = machine(x)
        assert sound[i] == ok
        assert not ok or fields[i] == want


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert parse_errors(df).count() == 0 and parse_clean(df).count() == 0


def test_control_characters_survive(spark):
    """U+0001 to U+0003 are data like any other, quoted or not."""
    odd = "a\u0001b\u0001\u0002c\u0001\u0003d\u0003\u0002"
    lines = [(1, "2020.csv", 1, f"S{odd},20200101,{odd},1.5,{odd},,,"), (2, "2020.csv", 2, f'S{odd},20200101,"x,{odd}",2,"{odd}",,,'), (3, "stations.txt", 3, f"{'S' + chr(1):<11}{10.0:>9}{20.0:>10}{5.0:>7} {odd}")]
    got = {r["line_id"]: r for r in parse_clean(spark.createDataFrame(lines, "line_id bigint, file_name string, line_no int, line string")).collect()}
    assert (got[1]["station_id"], got[1]["element"], got[1]["mflag"], got[1]["value"]) == (f"S{odd}", odd, odd, 1.5)
    assert (got[2]["station_id"], got[2]["element"], got[2]["mflag"]) == (f"S{odd}", f"x,{odd}", odd)
    assert (got[3]["station_id"], got[3]["name"], got[3]["lat"]) == ("S\u0001", odd, 10.0)
