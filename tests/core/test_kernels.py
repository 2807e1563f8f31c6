import itertools
import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from scorewright.functions import kernels as K
from scorewright.functions import text as X


def var(name="v", type="int", off=None, size=None, arg=None):
    return {"name": name, "type": type, "stack_offset": off, "size": size, "kind": "stack", "arg_index": arg}


def true(name, types, offs=(), arg=None):
    return {"name": name, "type": list(types), "offsets": list(offs), "is_arg": arg is not None, "arg_index": arg}


def test_type_forms():
    same = lambda a, b: bool(K.type_forms(a) & K.type_forms(b))
    assert same("undefined8", "long int") and same("unsigned long", "long long") and same("char * *", "char**") and same("_Bool", "bool")
    assert same("unsigned int", "int") and same("const char *", "char*") and same("size_t", "uint64_t") and same("short int", "__int16")
    assert not same("int", "int*") and not same("struct a *", "void *") and K.type_forms("") == set() == K.type_forms(None)


def test_bare_width():
    assert [K.bare_width(t, None) for t in ("undefined", "undefined4", "_QWORD", "__int64", "int4", "word", "int", "undefined8 *", "undefined3")] == [1, 4, 8, 8, 4, 2, None, None, None]
    assert K.bare_width("undefined", 4) == 4 and K.bare_width("int8", 3) == 8


def test_offsets_then_names():
    r = K.type_match([true("x", ["int"], [-4])], [var("v0", "int", -4)])
    assert (r["value"], r["tp"], r["shift"], r["by_offset"]) == (1.0, 1, 0, 1)
    r = K.type_match([true("x", ["int"], [])], [var("x", "char")])
    assert (r["value"], r["fp"], r["by_name"]) == (0.0, 1, 1)
    assert K.type_match([true("x", ["int"], [-4])], [])["fn"] == 1 and K.type_match([], [var()])["value"] == 0.0


def test_arguments_by_position():
    r = K.type_match([true("n", ["int"], arg=0), true("s", ["char*"], arg=1)], [var("a0", "unsigned int", arg=0), var("a1", "char *", arg=1)])
    assert (r["value"], r["by_arg"]) == (1.0, 2)


def test_each_variable_counts_once():
    r = K.type_match([true("x", ["int"], [-4]), true("x", ["int"], [-4])], [var("x", "int", -4)])
    assert (r["tp"], r["fn"]) == (1, 1)


def test_width_only_types_match_scalars_of_the_width():
    hit = lambda want, got: K.type_match([true("x", want, [-8])], [var("l", got, -8)])["tp"]
    assert hit(["long long"], "undefined8") and not hit(["char*"], "undefined8") and hit(["short"], "_WORD") and not hit(["double"], "undefined8")


def test_shifts():
    assert K.function_shift([-4, -5], [12, 11]) == -16 and K.function_shift([], [1]) is None and K.function_shift([5], [1]) == 4
    assert K.function_shift([0, 100], [1, 50]) is None and K.function_shift([1, 100], [1, 50]) == 0
    assert K.binary_shift([([-8], [-12]), ([-12], [-16]), ([-16], [-20]), ([-4], [-4])]) == 0
    assert K.binary_shift([([-4, -8], [12, 8])]) == -16 and K.binary_shift([([9], [1])]) is None and K.binary_shift([]) is None
    r = K.type_match([true("a", ["int"], [-4]), true("b", ["int"], [-5])], [var("p", "int", 12), var("q", "int", 11)])
    assert (r["value"], r["shift"]) == (1.0, -16)


def test_election_in_sql_matches_the_kernel(spark):
    r = random.Random(8)
    rows = []
    for g in range(40):
        k = r.randint(-40, 40)
        for f in range(r.randint(1, 4)):
            t = r.sample(range(-60, 0), r.randint(0, 4))
            rows.append((f"g{g}", g * 10 + f, t, [x + k + r.choice([0, 0, 0, 3]) for x in t][: r.randint(0, 4)]))
    df = spark.createDataFrame(rows, "group string, fn_id int, truth array<int>, found array<int>")
    got = {x["group"]: x["shift"] for x in K.elect_shift(df).collect()}
    for g, own in itertools.groupby(rows, key=lambda x: x[0]):
        assert got.get(g) == K.binary_shift([(t, f) for *_, t, f in own]), g


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j + 1], row[j])
    return row[-1]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=12), st.lists(st.sampled_from("abc"), max_size=12))
def test_line_diff(a, b):
    like, changed = K.line_diff(a, b)
    shared = lcs(a, b)
    assert changed == len(a) + len(b) - 2 * shared
    assert like == (1.0 if not a and not b else 0.0 if not a or not b else shared / (len(a) + len(b) - shared))


def shuffled(n, edges, r):
    p = list(range(n))
    r.shuffle(p)
    return list(range(n)), [(p[a], p[b]) for a, b in edges]


def test_graph_distance_is_zero_iff_isomorphic():
    r = random.Random(2)
    for _ in range(60):
        n = r.randint(1, 6)
        e = {(a, b) for a in range(n) for b in range(n) if r.random() < 0.3}
        f = {(a, b) for a in range(n) for b in range(n) if r.random() < 0.3}
        assert K.graph_distance(range(n), e, *shuffled(n, e, r)) == 0.0
        same = any({(p[a], p[b]) for a, b in e} == f for p in itertools.permutations(range(n)))
        assert (K.graph_distance(range(n), e, range(n), f) == 0.0) == same


def test_graph_distance_bounds():
    assert K.graph_distance([], [], [0], []) == float("inf")
    assert K.graph_distance(range(61), [], range(10), [(0, 1)]) == 52.0
    assert K.graph_distance([0, 1], [(0, 1)], [0, 1], []) >= 1
    assert K.graph_distance(range(3), [(0, 1), (1, 2)], range(4), [(0, 1), (1, 2), (2, 3)]) == 2.0


def test_text(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    src = 'int before;\n# 1 "/usr/include/stdio.h" 1 3\nextern int printf;\n# 5 "main.c" 2\nint main(void)\n{\n}\n# 1 "<built-in>"\nx\n# 9 "util.h"\nint u;\n'
    assert one(X.strip_system_headers(F.lit(src))) == "int main(void)\n{\n}\nint u;\n"
    assert one(X.sanitize_c(F.lit("unsigned int [4] f(int a @ rax) { char b[16]; __int128 x; }"))) == "unsigned int f(int a) { char b[16]; long long x; }"
    norm = lambda m, o: one(X.normalize_operands(F.lit(m), F.lit(o)))
    assert norm("mov", "rax, [rip + 0x40]") == "rax, [rip+X]" and norm("mov", "eax, [rip]") == "eax, [rip+X]"
    assert norm("call", "0x4010") == "X" and norm("call", "[rax + 0x20]") == "[rax + 0x20]" and norm("adrp", "x0, #0x400000") == "xX, X"
    lines = F.array(*[F.lit(x) for x in ("nop", "xor eax, eax", "call X", "mov eax, 0", "ret", "xor eax, eax")])
    assert one(X.drop_padding(lines)) == ["call X", "mov eax, 0", "ret", "xor eax, eax"]
    code = "junk\n// Function: main @ 0x401000\nint main() { return 0; }\n\n// Function: f @ 0x10\na\n// Function: f @ 0x20\n\n  b\n"
    assert [tuple(x) for x in one(X.function_blocks(F.lit(code)))] == [("main", 0x401000, "int main() { return 0; }"), ("f", 0x20, "b")]
    assert one(X.first_identifier(F.lit("/* x( */ #d\n// y(\nif (a) { foo (1); }"))) == "foo"
    assert one(X.fenced_code(F.lit("text\n```c\nint x;\n```\nmore"))) == "int x;" and one(X.fenced_code(F.lit(" int y; "))) == "int y;"
    assert one(X.byte_ratio(F.array(*map(F.lit, (1, 2, 3))), F.array(*map(F.lit, (1, 9))))) == 1 / 3
    assert one(X.trace_label(F.lit("O0"), F.lit("p"), F.lit("s"), F.lit("f"), F.lit(255))) == "O0__p__s__f_0xff"
    assert one(X.codegen_flags(F.lit("GNU C17 11.2 -masm=att -mtune=generic -march=x86-64 -g -O2 -fno-inline -fomit-frame-pointer -fPIC"))) == ["-mtune=generic", "-march=x86-64", "-O2", "-fomit-frame-pointer", "-fPIC"]


def test_graph_stats(spark):
    df = spark.createDataFrame([([0, 1, 2, 3], [(0, 1), (0, 2), (1, 3), (2, 3)])], "nodes array<int>, edges array<struct<u:int,v:int>>")
    r = df.select(*[c.alias(k) for k, c in K.graph_stats(F.col("nodes"), F.col("edges")).items()]).first()
    assert (r.nodes, r.edges, r["size"], r.cyclomatic, r.entries, r.exits, r.avg_out) == (4, 4, 8, 2, 1, 1, 1.0) and abs(r.density - 4 / 12) < 1e-12
