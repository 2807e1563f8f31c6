from pyspark.sql import functions as F

from scorewright.functions import c_text as C
from scorewright.operators import repairs


def test_variables():
    code = "int helper(int);\nint wcomment(FILE *fp, int c, void (*cb)(int, char), char buf[4], int)\n{\n  unsigned long v1 = f(2);\n  char *s[3];\n  return x;\n  int c;\n}"
    assert C.variables(code, "wcomment") == [("fp", "FILE *", "arg", 0), ("c", "int", "arg", 1), ("cb", "void (*)(int, char)", "arg", 2), ("buf", "char", "arg", 3), ("", "int", "arg", 4), ("v1", "unsigned long", "stack", None)]
    assert C.variables("void f(void) {\n int a; }", "f") == [("a", "int", "stack", None)] and C.variables(None, None) == []
    assert C.definition("f(1); int f(int a) { }", "f")[0] == 10 and C.definition("int f(int a);", "f") is None
    assert C.split_commas("a, b(c, d), {e, f}") == ["a", " b(c, d)", " {e, f}"] and C.split_commas("") == []


def test_functions_of_a_program():
    code = 'int a(int x)\n{ if (x) { return 1; } return 0; }\nstatic char *b(void) { puts("}"); }\nint a(void) { }\nint c(void);\n'
    out = dict(C.functions_of(code))
    assert list(out) == ["a", "b"] and out["a"].endswith("return 0; }") and out["b"].endswith('puts("}"); }')


def test_tokens():
    assert C.sanitize_tokens('x = std::foo("a::b @ c"); y u>> 2; -1f; 0x1f') == 'x = foo("a::b @ c"); y >> 2; -1; 0x1f'
    assert C.sanitize_tokens("v._4_2_ = 1; *(void *)p") == "(*(unsigned short *)((char *)&v + 4)) = 1; *(unsigned long *)p"
    assert C.sanitize_tokens("unsigned int [166] f(int a @ rax)") == "unsigned int *f(int a)"
    twice = "typedef struct s { int a; } s;\ntypedef struct s { int a; int b; } s;"
    assert C.sanitize_tokens(twice) == "\ntypedef struct s { int a; int b; } s;" and C.sanitize_tokens(None) is None


def test_annotations_and_literals():
    assert C.sanitize_tokens("fprintf(GLIBC_2.2.5::stderr, msg);") == "fprintf(stderr, msg);"
    assert C.sanitize_tokens("int f(int a) { return a + 1; }") == "int f(int a) { return a + 1; }"
    assert C.sanitize_tokens("int main() __noreturn {") == "int main() {"
    assert C.sanitize_tokens('void f() __convention("regparm") {') == "void f() {"
    assert C.sanitize_tokens("int __cdecl g(int a)") == "int g(int a)"
    kept = 'puts("__cdecl 1f a::b"); // __cdecl\n/* x @ eax */ char c = \'@\';'
    assert C.sanitize_tokens(kept) == kept and C.sanitize_tokens("goto (f)(x);") == "goto *(void *)(x);"
    assert C.without_literals('a("x//y", \'c\') /* d */ + 1; // e') == 'a("", \'\')  + 1; ' and C.without_literals(None) is None


def test_definitions():
    old = "void send(s, n);\nlocal void send(s, n)\n    state *s;\n    int n, m;\n{ rank = n; }\n\nvoid next_fn(void) { }\n"
    assert C.definition_text(old, "send") == "local void send(s, n)\n    state *s;\n    int n, m;\n{ rank = n; }"
    assert C.definition_text("int foo();\n\nint bar(void) {\n    return 42;\n}\n", "foo") is None
    assert C.definition_text("int main(void) { return helper(1); }\nstatic int helper(int x) { return x * 2; }", "helper") == "static int helper(int x) { return x * 2; }"
    two = "#if A\nint f(void) { return 1; }\n#else\nint f(void) { return 2; }\n#endif\n"
    assert "1" in C.definition_text(two, "f") and "2" in C.definition_text(two, "f", 4) and C.definition_text(None, "f") is None
    assert C.definition_text("int reg(int (*cb)(int), int n) { return cb ? n : 0; }", "reg").startswith("int reg(")
    assert C.renamed("int foo(int a) { return foo(a) + foobar; } // foo", "zed") == "int zed(int a) { return zed(a) + foobar; } // foo"
    assert C.renamed("x = 1;", "zed") == "x = 1;" and C.renamed(None, "zed") is None


def test_udfs(spark):
    df = spark.createDataFrame([("int f(int a) { }", "f"), (None, None)], "code string, name string")
    out = df.select(C.variables_udf()("code", "name").alias("v"), C.sanitize_tokens_udf()("code").alias("s"), C.functions_udf()("code").alias("f")).collect()
    assert out[0].v[0]["name"] == "a" and out[0].f[0]["name"] == "f" and out[1].s is None and out[1].v == []


def test_relations(spark):
    fn = spark.createDataFrame([("my-app", 1, "main"), ("x_app", 2, "f"), ("app2", 3, "g"), ("a-b-app", 4, "h")], "stem string, addr long, name string")
    got = repairs.source_names(fn, spark.createDataFrame([("p", "app")], "project string, wanted string")).collect()
    assert {r.name for r in got} == {"main", "f", "h"}
    g = spark.createDataFrame([([7, 3], [(7, 3)])], "nodes array<int>, edges array<struct<u:int,v:int>>")
    r = repairs.relabelled(g).first()
    assert r.nodes == [0, 1] and tuple(r.edges[0]) == (0, 1)
    files = spark.createDataFrame([("p", "a/b/x.c"), ("p", "x.c"), ("p", "y/x.c")], "project string, path string")
    assert repairs.shallowest(files).first().path == "x.c"
    key = spark.range(2).select(repairs.memo_key("id").alias("key"))
    assert repairs.memo_misses(key, key.limit(1)).count() == 1
    cols = "project string, opt_level string, binary_name string, function_name string"
    cases = spark.createDataFrame([("p", "O0", "b", "f"), ("p", "O0", "b", "g")], cols)
    blocks = spark.createDataFrame([("p", "O0", "b", "f", "z", 3), ("p", "O0", "b", "f", "t", 2), ("p", "O0", "b", "f", "k", 1)], cols + ", dec string, addr long")
    assert {r.function_name: r.addr for r in repairs.locate(cases, blocks, "k", "t").collect()} == {"f": 1, "g": None}
    graphs = blocks.select("*", F.lit(1).alias("graph"))
    assert repairs.scored_pairs(cases.withColumn("graph", F.lit(0)), graphs, blocks.where("dec = 'k'")).count() == 1
    m = spark.createDataFrame([("O0", 1, "f", 5), ("O0", 2, "f", 6)], "opt_level string, pos int, name string, graph int")
    assert repairs.merged_graphs(m).first().graph == 6
