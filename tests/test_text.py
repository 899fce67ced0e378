"""Chunks, symbols, references, plans, read plans, shell commands and ignore rules on small inputs."""

import pytest
from pyspark.sql import functions as F

from quarryline.functions import paths, shell, text
from quarryline.operators import chunk, context, graph, references, symbols
from quarryline.operators.readplan import plan
from quarryline.plans import views
from quarryline.plans.query_plan import plan_query
from quarryline.sources import ignore, scan


def spans(t, lang):
    return [(a, b, k) for a, b, k, _ in chunk.chunks_of(t, lang)]


def test_windows_overlap_and_stop_at_the_end():
    assert spans("\n".join("x" * 1 for _ in range(200)), "text") == [(1, 80, "text"), (71, 150, "text"), (141, 200, "text")]
    assert spans("\n".join("x" for _ in range(80)), "text") == [(1, 80, "text")]
    assert spans("", "json") == [(1, 1, "text")]


def test_markdown_sections_ignore_fences():
    body = ["# Title"] + ["words"] * 9 + ["```", "# not a heading"] + ["code"] * 9 + ["```", "## Next", "end"]
    assert spans("\n".join(body), "markdown") == [(1, 22, "markdown"), (23, 24, "markdown")]


def test_code_blocks():
    ts = "import x\n\nexport class A {\n  run() { return '}' }\n}\nconst f = (a) => {\n  // }\n  return /}/.test(a)\n}\nconst g = (a) =>\n  a + 1\n\nlast()"
    assert spans(ts, "typescript") == [(1, 2, "text"), (3, 5, "class"), (6, 9, "function"), (10, 11, "function"), (12, 13, "text")]
    py = "class A:\n    def f(self):\n        pass\n\nx = 1\nasync def g():\n\n    return 2"
    assert spans(py, "py") == [(1, 3, "class"), (4, 5, "text"), (6, 8, "function")]


@pytest.mark.parametrize("lang,line,kind,name", [
    ("typescript", "export default class Foo {", "class", "Foo"), ("javascript", "const go = async (x) => 1", "function", "go"), ("typescript", "  load(a) {", "method", "load"), ("typescript", "export interface P {", "interface", "P"),
    ("py", "  async def run(self):", "function", "run"), ("markdown", "## Some title", "heading", "Some title"), ("go", "func (s *S) Get(x int) {", "method", "Get"), ("go", "type T struct {", "class", "T"),
    ("rs", "pub(crate) async fn go<T>() {", "function", "go"), ("rs", "trait T {", "interface", "T"), ("java", "public final class A {", "class", "A"), ("java", "  public static int f(int a) {", "method", "f"),
    ("kt", "suspend fun go() {", "function", "go"), ("kt", "data class P(val x: Int)", "class", "P"), ("rb", "  def self.make!", "method", "make!"), ("php", "  public static function f() {", "method", "f"),
    ("c", "struct Node {", "struct", "Node"), ("c", "static int add(int a, int b) {", "function", "add"), ("cpp", "void Foo::bar() {", "method", "bar"),
])
def test_symbols(spark, lang, line, kind, name):
    df = spark.createDataFrame([(1, lang, "// nothing\n" + line if lang not in ("markdown", "py", "rb") else line)], "id long, language string, text string")
    assert [(r.kind, r.name) for r in symbols.extract(df, ["id"]).collect()] == [(kind, name)]


def test_no_symbols_for_control_flow_and_prototypes(spark):
    df = spark.createDataFrame([(1, "c", "int f(int a);\nif (x) {\nstruct S;"), (2, "typescript", "if (x) {\nreturn (y) {")], "id long, language string, text string")
    assert symbols.extract(df, ["id"]).count() == 0


def test_references():
    got = references.extract_one("import {\n a } from './a.js?x#y'\nimport 'b'\nexport * from './a.js'\nrequire(\"/abs\")\nimport('https://x')", "typescript", "src/m.ts")
    assert got == [("import", "./a.js", 1, 2), ("import", "b", 3, 3)] or got == [("import", "./a.js", 1, 2), ("import", "b", 2, 3)]
    py = references.extract_one("from ..pkg.mod import x\nfrom . import a, b as c, (d)", "py", "p/q/m.py")
    assert [s for _, s, _, _ in py] == ["../pkg/mod", "./a", "./b"]
    assert references.candidates("import", "src/m.ts", "typescript", "./a.js")[:3] == ["src/a.js", "src/a.ts", "src/a.tsx"]
    assert references.candidates("import", "m.ts", "typescript", "../../x") == []
    assert references.candidates("include", "src/m.c", "c", "lib/u.h") == ["src/lib/u.h"]


def test_alias_rules_take_the_nearest_configuration():
    root = references.alias_rules("tsconfig.json", '{ // c\n "compilerOptions": {"baseUrl": ".", "paths": {"@/*": ["src/*"], "@/core/*": ["core/*"],}}}')
    app = references.alias_rules("apps/web/tsconfig.json", '{"compilerOptions": {"paths": {"@/*": ["app/*", "lib/*"]}}}')
    assert references.alias_paths(root + app, "apps/web/x.ts", "@/a") == ["apps/web/app/a", "apps/web/lib/a"]
    assert references.alias_paths(root + app, "src/x.ts", "@/core/a") == ["core/a", "src/core/a"]
    assert references.alias_paths(root, "src/x.ts", "./a") == [] and references.alias_rules("tsconfig.json", "{bad") == []


def test_resolution_and_edges(spark):
    f = spark.createDataFrame([("a.ts", "typescript", "import './b'\nimport './a'"), ("b.tsx", "typescript", ""), ("b.js", "javascript", "")], "path string, language string, text string")
    e = references.edges(references.resolve(references.extract(f), f)).collect()
    assert [(r.src, r.dst, r.kind) for r in e] == [("a.ts", "b.tsx", "imports")]


def test_resolution_takes_the_first_candidate_of_each_form(spark):
    """Read backwards from the files, as candidates in order would find it: with aliases, endings, folders and repeated rows."""
    rows = [
        ("a/m.ts", "typescript", "import './n'\nimport './p'\nimport '@/n'\nimport './q.js'\nimport './none'"), ("a/n/index.ts", "typescript", ""), ("a/n.json", "json", ""), ("a/p/__init__.py", "py", ""), ("lib/n.md", "markdown", ""), ("app/n.js", "javascript", ""), ("a/q.tsx", "typescript", ""),
        ("a/u.py", "py", "from . import n, p\nfrom .k import z"), ("a/k.py", "py", ""), ("a/k.ts", "typescript", ""), ("a/v.c", "c", '#include "w"\n#include "k"'), ("a/w.hpp", "cpp", ""), ("a/w.c", "c", ""),
    ]
    f = spark.createDataFrame(rows + rows[:1], "path string, language string, text string")
    rules = references.alias_rules("tsconfig.json", '{"compilerOptions": {"paths": {"@/*": ["app/*", "lib/*"]}}}')
    got = sorted((r.src, r.dst) for r in references.edges(references.resolve(references.extract(f, rules), f)).collect())
    there, want = {p for p, _, _ in rows}, set()
    for path, lang, text in rows:
        for kind, spec, _, _ in references.extract_one(text, lang, path):
            want |= {(path, next(c for c in found)) for found in [[c for c in references.candidates(kind, path, lang, spec, references.alias_paths(rules, path, spec)) if c in there]] if found}
    assert got == sorted(want) and ("a/m.ts", "app/n.js") in want and ("a/m.ts", "a/n.json") in want and ("a/u.py", "a/p/__init__.py") in want and ("a/v.c", "a/w.hpp") in want


def test_references_of_large_files(spark):
    """Tens of thousands of references leave in batches, with the path they name and not with all that it may mean."""
    f = spark.range(8).selectExpr("concat('a/', id, '.ts') AS path", "'typescript' AS language", """array_join(transform(sequence(1, 4000), i -> concat('require("./x', i, '")')), '\n') AS text""").coalesce(1)
    out = references.extract(f)
    assert out.count() == 32_000 and out.filter("bases = array(concat('a/x', line_start)) and line_end = line_start and ref = line_start - 1").count() == 32_000


def test_long_status_in_one_pass(spark, monkeypatch):
    """A status of many entries takes time in proportion to them; old names go, in every batch, and empty ones are none."""
    text = "".join(f"R  new/{i} a.ts\0R  old/{i}\0 M x/{i}\0\0" for i in range(60_000))
    df = spark.createDataFrame([(text,), (None,), ("",), ("?? R\0CC b\0c",)], "status string")
    out = scan.porcelain(df)
    assert out.count() == 120_002 and out.filter("startswith(path, 'old/') or path = ''").count() == 0
    assert sorted((r.path, r.code, r.state) for r in out.filter("path not like '%/%'").collect()) == [("R", "??", "untracked"), ("b", "CC", "copied")]


def test_cycles_have_short_plans(spark, monkeypatch):
    """What is written reads each table a few times for its steps, not twice or four times as often with each step."""
    n, sizes, write = 30, [], graph.cut
    e = [(f"a{i:02}", f"a{(i + 1) % n:02}") for i in range(n)] + [(f"a{i:02}", f"b{i:02}") for i in range(9)] + [(f"b{i:02}", f"b{i + 1:02}") for i in range(9)] + [("b09", "c1"), ("c1", "c2"), ("c2", "b09"), ("x", "a00"), ("x", "x")]

    def cut(df):
        sizes.append(df._jdf.queryExecution().optimizedPlan().toString().count("Relation"))
        return write(df)

    monkeypatch.setattr(graph, "cut", cut)
    got = {(r.node, r.component) for r in graph.cycles(spark.createDataFrame(e, "src string, dst string")).collect()}
    assert got == {(f"a{i:02}", "a00") for i in range(n)} | {(x, "b09") for x in ("b09", "c1", "c2")} and max(sizes) <= 2 * graph.HOPS + 2


def test_neighbours_are_read_from_tables(spark):
    """The plan of all kinds of neighbours together has a table of each."""
    f = spark.createDataFrame([("src/a.ts", 1), ("src/a.test.ts", 1), ("README.md", 1)], "path string, size long")
    e = spark.createDataFrame([("src/a.test.ts", "src/a.ts", "imports", None, 1, 1)], "src string, dst string, kind string, specifier string, line_start int, line_end int")
    rel = context.related(f.select(F.col("path").alias("target")), f, e)
    plan = rel._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation") <= 13 and plan.count("Window") == 0
    assert ("src/a.ts", "src/a.test.ts", "sibling_test") in {(r.target, r.path, r.reason) for r in rel.collect()}


def test_pairs_are_told_apart_behind_the_shuffle(spark):
    plan = views.repo_edges(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "HashAggregate" not in plan.split("Exchange")[1]


def test_plan():
    p = plan_query('find "exact words" getUserName in src/app.ts')
    assert p.phrases == ["exact words"] and p.path_like and "getusername" in p.terms and "user" in p.terms
    assert [(t["kind"], t["boost"]) for t in p.tiers][:2] == [("phrase", 24), ("all", 18)]
    assert plan_query("session repo lookup").terms == ["session", "repo", "lookup", "scope"]
    assert plan_query("overview").role_intents == ["overview"] and plan_query("overview tab stock cards").role_intents == []
    assert plan_query("orders list endpoint returns items").endpoint_terms == ["orders", "list"]
    assert [t["boost"] for t in plan_query("ab").tiers] == [0] * len(plan_query("ab").tiers)
    with pytest.raises(ValueError):
        plan_query("  !! ")


def test_read_plan_buckets():
    got = plan(["src/a.ts", "src/b.ts", "tests/b.test.ts", "docs/archive/x.md"], [("src/c.ts", [("import", None)]), ("tests/a.test.ts", [("sibling_test", "src/a.ts")])], 9)
    assert got == [("src/a.ts", "first_search"), ("src/b.ts", "visible_search_pair"), ("tests/b.test.ts", "visible_search_pair"), ("tests/a.test.ts", "prioritized_test"), ("src/c.ts", "remaining_context"), ("docs/archive/x.md", "archived_search")]
    assert plan(["a"], [], 0) == []


@pytest.mark.parametrize("cmd,broad", [
    ("rg foo", True), ("rg foo src/a.ts", False), ("rg -g '*.ts' foo", True), ("grep -rn foo .", True), ("grep foo a.py", False), ("cat x | grep foo", False), ("git grep foo", True), ("find . -name '*.py'", True),
    ("find a.txt", False), ("find . -delete", False), ("echo 'rg foo'", False), ("FOO=1 sudo -n rg foo && ls", True), ("ls; rg --files README", False), ("grep -e x -r", True), ("", False),
])
def test_shell(cmd, broad):
    assert shell.broad(cmd) is broad


def test_ignore_rules(spark):
    p = ["a.log", "keep.log", "x/b.log", "build/x", "x/build/y", "docs/a/b.md", "docs/b.md"]
    rules = ignore.rules_of("# c\n*.log\n!keep.log\nbuild/\ndocs/*.md\n")
    df = spark.createDataFrame([(x,) for x in p], "path string").select("path", ignore.ignored(F.col("path"), rules).alias("i"))
    assert {r.path: r.i for r in df.collect()} == dict(zip(p, [True, False, True, True, False, False, True]))


def test_scan_reads_changed_files_only(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "node_modules").mkdir()
    for n, b in {"src/a.ts": b"let a", "src/b.bin": b"x", "src/c.md": b"a\0b", "node_modules/x.js": b"1", "src/__init__.py": b"", ".env": b"K=1"}.items():
        (tmp_path / n).write_bytes(b)
    first = {r.path: r for r in scan.scan(spark, str(tmp_path)).collect()}
    assert {p: r.skip_reason for p, r in first.items()} == {"src/a.ts": None, "src/b.bin": "unsupported extension", "src/c.md": "binary content", "node_modules/": "ignored directory", "src/__init__.py": None, ".env": "secret-like file"}
    known = scan.scan(spark, str(tmp_path)).filter("skip_reason is null").select("path", "size", "mtime_ms", "hash")
    again = {r.path: r for r in scan.scan(spark, str(tmp_path), "src", known=known).collect()}
    assert again["src/a.ts"].reused and again["src/a.ts"].text is None and again["src/a.ts"].hash == first["src/a.ts"].hash and set(again) == {"src/a.ts", "src/b.bin", "src/c.md", "src/__init__.py", "node_modules/"}


def test_incomplete_scans_delete_nothing(spark):
    i, s = spark.createDataFrame([("a",), ("b",)], "path string"), spark.createDataFrame([("a",)], "path string")
    assert scan.deletions(i, s, "", False).count() == 0 and [r.path for r in scan.deletions(i, s, "", True).collect()] == ["b"]


def test_paths(spark):
    assert paths.normalize_prefix("./a//b/../c\\") == "a/c/" and paths.normalize_prefix(None) == ""
    df = spark.createDataFrame([("a", "a.test"), ("a.b", "a"), ("a", "a"), ("a", "ab")], "x string, y string")
    assert [r.z for r in df.select(paths.stem_affinity(F.col("x"), F.col("y")).alias("z")).collect()] == [True, True, False, False]


def test_text(spark):
    one = spark.range(1)
    get = lambda c: one.select(c.alias("x")).first().x
    assert get(text.round_up(F.lit(-2.5), 0)) == -2.0 and get(text.occurrences(F.lit("aaaa"), F.lit("aa"))) == 2
    assert get(text.matched(F.lit("über a.b x"), F.array(F.lit("über"), F.lit("a.b"), F.lit("b"), F.lit("xx")))) == ["über", "a.b", "b"]
    assert get(text.tokens(F.lit("Café_au-lait 42"))) == ["cafe", "au", "lait", "42"]
    lines = "\n".join(f"line {i}" for i in range(9))
    assert get(text.snippet(F.lit(lines), F.array(F.lit("line 5")))) == "line 3\nline 4\nline 5\nline 6\nline 7"
    assert get(text.snippet(F.lit(lines), F.array(F.lit("line 0")))) == "line 0\nline 1\nline 2"
    assert len(get(text.squeeze(F.lit("x" * 900)))) == 700


def test_read_first_starts_with_the_target(spark):
    f = spark.createDataFrame([("src/a.ts", 1), ("src/a.test.ts", 1), ("src/b.ts", 1), ("src/a-util.ts", 1), ("README.md", 1), ("src/x.config.json", 1)], "path string, size long")
    e = spark.createDataFrame([("src/a.ts", "src/b.ts", "imports", "./b", 1, 1)], "src string, dst string, kind string, specifier string, line_start int, line_end int")
    t = spark.createDataFrame([("src/a.ts",)], "target string")
    out = [(r.path, [x.kind for x in r.reasons]) for r in context.read_first(context.related(t, f, e), t).orderBy("place").collect()]
    assert out[0] == ("src/a.ts", ["target"]) and out[1] == ("src/b.ts", ["import"]) and ("src/a.test.ts", ["sibling_test"]) in out and ("README.md", ["related_doc"]) in out and ("src/a-util.ts", ["same_dir"]) in out


def test_neighbour_tests_and_reasons(spark):
    """Tests of what a target imports, of what imports it, and of its counterpart; reasons name both ends."""
    names = ["src/a.ts", "src/b.ts", "lib/c.ts", "lib/c.test.ts", "src/use.ts", "tests/use.spec.ts", "src/a.test.ts", "native/u.c", "native/u.h", "native/tests/u_test.c", "README.md", "docker-compose.yml"]
    f = spark.createDataFrame([(p, 10) for p in names], "path string, size long")
    e = spark.createDataFrame([("src/a.ts", "lib/c.ts", "imports", "../lib/c", 1, 1), ("src/use.ts", "src/a.ts", "imports", "./a", 1, 1), ("src/a.test.ts", "src/a.ts", "imports", "./a", 1, 1)], "src string, dst string, kind string, specifier string, line_start int, line_end int")
    t = spark.createDataFrame([("src/a.ts",), ("native/u.h",), ("src/a.test.ts",)], "target string")
    rel = context.related(t, f, e)
    out = {}
    for r in context.read_first(rel, t, 25).orderBy("target", "place").collect():
        out.setdefault(r.target, {})[r.path] = [(x.kind, x.source, x.to, x.specifier) for x in r.reasons]
    a = out["src/a.ts"]
    assert list(a)[:2] == ["src/a.ts", "lib/c.ts"]
    assert a["lib/c.ts"] == [("import", "src/a.ts", "lib/c.ts", "../lib/c")]
    assert a["lib/c.test.ts"] == [("sibling_test", "lib/c.test.ts", "lib/c.ts", None)]
    assert a["tests/use.spec.ts"] == [("sibling_test", "tests/use.spec.ts", "src/use.ts", None)]
    assert a["src/use.ts"] == [("reverse_import", "src/use.ts", "src/a.ts", "./a")]
    assert {k for k, *_ in a["src/a.test.ts"]} >= {"reverse_import", "reverse_test"}
    assert a["docker-compose.yml"][0][0] == "near_config" and a["README.md"][0][0] == "related_doc"
    u = out["native/u.h"]
    assert list(u)[:2] == ["native/u.h", "native/u.c"] and "native/tests/u_test.c" in u
    assert {k for k, *_ in out["src/a.test.ts"]["src/a.ts"]} == {"import", "test_of"}
    hints = {(r.target, r.role): r.path for r in rel.filter("role is not null").collect()}
    assert hints[("native/u.h", "pair_test")] == "native/tests/u_test.c" and hints[("src/a.ts", "import_test")] == "lib/c.test.ts" and hints[("src/a.ts", "importer_test")] == "tests/use.spec.ts"


def test_nearest_of_a_key_that_many_share(spark):
    import random

    r = random.Random(3)
    made = sorted({"/".join(r.choice("abc") for _ in range(r.randint(0, 3))) + f"/f{r.randrange(200)}" for _ in range(160)})
    made = [p.lstrip("/") for p in made]
    df = spark.createDataFrame([(p, 1) for p in made], "path string, key int")
    got = context._near(context.nearest(df.withColumnRenamed("path", "target"), df, ["key"], 3).withColumn("reason", F.lit("x")), 3)
    every = context._near(df.select(F.col("path").alias("target"), "key").join(df, "key").withColumn("reason", F.lit("x")), 3)
    rows = lambda x: sorted((y.target, y["rank"], y.path) for y in x.collect())
    assert rows(got) == rows(every)


def test_shortest_paths_name_their_files(spark):
    e = spark.createDataFrame([("a", "b", "imports"), ("b", "c", "imports"), ("a", "d", "imports"), ("d", "c", "imports"), ("c", "e", "imports")], "src string, dst string, kind string")
    got = {r.path: (r.hops, list(r.trail)) for r in graph.shortest_paths(spark.createDataFrame([("a",)], "start string"), e, 4).collect()}
    assert got["c"] == (2, ["a", "b", "c"]) and got["e"] == (3, ["a", "b", "c", "e"]) and got["a"] == (0, ["a"])


def test_long_cycle_and_hub(spark):
    ring = [(f"r{i:03d}", f"r{(i + 1) % 60:03d}") for i in range(60)]
    tail = [(f"t{i}", f"t{i + 1}") for i in range(30)] + [("t30", "r000"), ("r010", "x0")] + [(f"x{i}", "hub") for i in range(20)] + [("hub", "hub"), ("x3", "x4"), ("x4", "x3")]
    got = {r.node: r.component for r in graph.cycles(spark.createDataFrame(ring + tail, "src string, dst string")).collect()}
    assert got == {**{f"r{i:03d}": "r000" for i in range(60)}, "x3": "x3", "x4": "x3"}
