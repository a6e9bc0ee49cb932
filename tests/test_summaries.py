"""Golden cases of captured runs: label, headline, details."""

import collections
import random

import pytest
from pyspark.sql import functions as F

from tracewell.operators.classify import classified, kept_native
from tracewell.operators.summarize import output_modes, rendered, summarized

SCHEMA = "run_id string, argv array<string>, stdout string, stderr string, exit_code int"

LABELS = {
    "git -C /x status --short": "git.status", "git log": "git.log", "git frob": "unknown", "docker ps": "docker.ps", "docker-compose logs web": "docker.logs",
    "docker compose -f a.yml up": "docker.compose", "docker run x": "unknown", "pip install x": "python.pip", "uv run pytest -q": "python.pytest", "uv sync": "python.uv",
    "poetry run python -m mypy": "python.uv" if False else "python.poetry", "python3 -m pytest": "python.pytest", "python -mmypy": "python.mypy", "ruff check": "python.ruff",
    "eslint .": "lint.eslint", "npx eslint .": "lint.eslint", "npm run prettier": "lint.prettier", "go tool -modfile x golangci-lint run": "lint.golangci-lint", "bun x biome": "lint.biome",
    "pnpm exec vitest": "test.vitest", "yarn jest": "test.jest", "npx playwright test": "test.playwright", "go test ./...": "test.go", "bundle exec rspec": "test.rspec", "ruby -Itest a.rb": "test.minitest", "bin/rails test": "test.minitest",
    "npm install": "node.npm", "bunx cowsay": "node.npx", "cargo --config x build": "rust.cargo-build", "cargo nextest run": "rust.cargo-nextest", "gh -R a/b pr list": "gh.pr",
    "kubectl get -n x pods": "k8s.kubectl-pods", "kubectl logs a": "k8s.kubectl-logs", "tsc": "build.tsc", "vite build": "build.vite", "./gradlew b": "build.gradle", "mvn x": "build.maven", "dotnet test": "build.dotnet-test",
    "rg --files": "generic.rg-files", "rg x": "generic.rg", "sed -n 1,20p f": "generic.text-excerpt", "cat f": "generic.cat", "frob": "unknown",
}


def run(spark, rows):
    data = [(str(i), a, o, e, x) for i, (a, o, e, x) in enumerate(rows)]
    out = summarized(classified(spark.createDataFrame(data, SCHEMA))).orderBy(F.col("run_id").cast("int"))
    return [(r["label"], r["summary"]["summary"], list(r["summary"]["details"]), r) for r in out.collect()]


def test_labels(spark):
    rows = [(c, c.split(" "), "", "", 0) for c in LABELS]
    rows += [("sh -c 'FOO=1 git status'", ["sh", "-c", "FOO=1 git status"], "", "", 0), ("bash -lc pipe", ["bash", "-lc", "git log | head"], "", "", 0), ("nl", ["sh", "-c", "nl -ba f | sed -n '5,9p'"], "", "", 0)]
    got = {r["run_id"]: r["label"] for r in classified(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == LABELS | {"sh -c 'FOO=1 git status'": "git.status", "bash -lc pipe": "unknown", "nl": "generic.text-excerpt"}


def test_kept_native(spark):
    cases = {"vim x": True, "tail -f x": True, "tail x": False, "docker run x": True, "docker compose up": True, "docker ps": False, "npm run dev": True, "npm run build": False, "env A=1 ssh h": True, "python -m http.server": True, "python manage.py runserver": True, "cargo build": False}
    df = spark.createDataFrame([(c, c.split(" ")) for c in cases], "c string, argv array<string>")
    assert {r[0]: r[1] for r in df.select("c", kept_native(F.col("argv"))).collect()} == cases


DIFF = "diff --git a/src/lib.rs b/src/lib.rs\n@@ -1,2 +1,3 @@\n-old\n+new\n+more\n"
POD = "NAME READY STATUS RESTARTS AGE\napi 1/1 Running 0 1d\njob 0/1 CrashLoopBackOff 3 1h\n"
JEST = '{"numPassedTests":2,"numFailedTests":1,"numPendingTests":0,"testResults":[{"name":"a.js","assertionResults":[{"fullName":"adds","status":"failed","failureMessages":["Expected 1"]}]}]}'
PLAY = '{"stats":{"expected":1,"unexpected":1,"skipped":0,"duration":12.5},"suites":[{"title":"t","file":"a.spec.ts","specs":[],"suites":[{"title":"in","specs":[{"title":"works","ok":false,"tests":[{"status":"unexpected","results":[{"status":"failed","errors":[{"message":"boom"}]}]}]}]}]}]}'
MYPY = "src/a.py:1: error: bad  [arg]\nsrc/a.py:1: note: see\nsrc/b.py:2: error: worse  [call]\nFound 2 errors in 2 files\n"
GO = '{"Action":"output","Package":"p","Test":"T","Output":"  bad\\n"}\n{"Action":"fail","Package":"p","Test":"T","Elapsed":0.5}\n{"Action":"pass","Package":"p","Test":"U"}\n'
CARGO = "test result: ok. 2 passed; 0 failed; 1 ignored; 0 measured; 0 filtered out; finished in 0.10s\ntest result: ok. 3 passed; 0 failed; 0 ignored; 0 measured; 4 filtered out; finished in 1.50s\n"
HITS = "".join(f"a:{i}:x\n" for i in range(30)) + "".join(f"b:{i}:x\n" for i in range(5))

CASES = [
    (["git", "diff"], DIFF, "", 0, "1 files changed, 1 hunks, +2/-1", ["src/lib.rs (+2/-1, 1 hunk) — @@ -1,2 +1,3 @@ | -old | +new | +more"]),
    (["git", "status"], "On branch main\nChanges to be committed:\n\tmodified:   a\nUntracked files:\n\tb\n", "", 0, "* main", ["M  a", "?? b"]),
    (["git", "status", "--short"], " M a\n?? b\n", "", 0, " M a", ["?? b"]),
    (["git", "status"], "## main\n", "", 0, "* main", ["clean — nothing to commit"]),
    (["git", "log"], "commit 0123456789abcdef\nAuthor: x\nDate: y\n\n    Fix it\n", "", 0, "1 commits", ["0123456 Fix it"]),
    (["git", "branch", "-a"], "* main\n  dev\n  remotes/origin/HEAD -> origin/main\n  remotes/origin/dev\n  remotes/origin/new\n", "", 0, "current=main; local=2; remote_only=1", ["* main", "dev", "remote-only (1): new"]),
    (["git", "pull"], "Updating a..b\n 2 files changed, 3 insertions(+), 1 deletion(-)\n", "", 0, "ok 2 files, +3/-1", ["2 files changed, 3 insertions(+), 1 deletion(-)"]),
    (["git", "fetch"], "", " * [new branch]      x -> origin/x\n", 0, "ok fetched (1 new refs)", ["origin/x"]),
    (["git", "stash", "list"], "stash@{0}: WIP on main: abc msg\n", "", 0, "1 stash entries", ["stash@{0}: abc msg"]),
    (["docker", "images"], "REPOSITORY  TAG  IMAGE ID  CREATED  SIZE\na  1  x  now  512MB\nb  2  y  now  1GB\n", "", 0, "2 images (1.5GB)", ["a:1 — x (512MB)", "b:2 — y (1GB)"]),
    (["docker", "ps"], "CONTAINER ID  IMAGE  COMMAND  STATUS  NAMES\nabc  img  run  Up 2 hours  web\n", "", 0, "1 containers; 1 running", ["web — img (Up 2 hours)"]),
    (["docker", "inspect", "x"], '[{"Name":"/web","Id":"0123456789abcdef","State":{"Status":"running"}}]', "", 0, "1 inspect objects; name=web", ["id=0123456789ab", "status=running"]),
    (["docker", "logs", "web"], "ok\nERROR one\nwarn\n", "", 0, "logs for web: 1 errors, 1 warnings", ["ERROR one"]),
    (["kubectl", "get", "pods"], POD, "", 0, "2 pods | running=1 pending=0 failed=1 restarts=3", ["api Running", "job CrashLoopBackOff (3 restarts)"]),
    (["kubectl", "apply", "-f", "x"], "a created\nb unchanged\n", "", 0, "kubectl apply: 1 created, 1 unchanged", ["a created", "b unchanged"]),
    (["gh", "pr", "list"], "12\tFix it\tbranch\n", "", 0, "1 PRs", ["#12 Fix it"]),
    (["jest"], JEST, "", 1, "PASS (2) FAIL (1)", ["1. adds", "   a.js", "   Expected 1"]),
    (["npx", "playwright", "test"], PLAY, "", 1, "PASS (1) FAIL (1)", ["1. in > works", "   boom", "", "Time: 12ms"]),
    (["go", "test"], GO, "", 1, "PASS (1) FAIL (1)", ["1. p::T", "   bad", "", "Time: 500ms"]),
    (["mypy", "."], MYPY, "", 1, "mypy: 2 errors in 2 files", ["Top codes: arg (1x), call (1x)", "", "src/a.py (1 errors)", "  L1: [arg] bad", "    see", "src/b.py (1 errors)", "  L2: [call] worse"]),
    (["eslint", "."], "src/a.js:1:2: Bad. [Error/no-x]\nsrc/a.js:2:2: Meh. [Warning/y]\n", "", 1, "ESLint: 1 error, 1 warning in 1 file", ["Top rules:", "  no-x (1x)", "  y (1x)", "", "Top files:", "  src/a.js (2 issues)", "    no-x (1)", "    y (1)"]),
    (["golangci-lint", "run"], '{"Issues":[{"FromLinter":"errcheck","Text":"unchecked","Pos":{"Filename":"cmd/x.go"}}]}', "", 1, "golangci-lint: 1 issues in 1 files", ["Top linters:", "  errcheck (1x)", "", "Top files:", "  cmd/x.go (1 issues)", "    errcheck (1)", "      -> unchecked"]),
    (["cargo", "test"], CARGO, "", 0, "cargo test: 5 passed; 0 failed; 1 ignored; 0 measured; 4 filtered out; finished in 1.50s", []),
    (["cargo", "build"], "", "error[E0308]: mismatched\nwarning: unused\n", 1, "cargo build: 1 errors, 1 warnings", ["error[E0308]: mismatched", "warning: unused"]),
    (["pytest"], "=== FAILURES ===\n___ test_a ___\nE   assert 1 == 2\n=== short test summary info ===\nFAILED a.py::test_a\n=== 1 failed, 2 passed in 0.1s ===\n", "", 1, "Pytest: 2 passed, 1 failed", ["Failures:", "1. test_a | E   assert 1 == 2"]),
    (["rspec"], "Failures:\n\n  1) it works\n     expected 1\n\n3 examples, 1 failure, 1 pending\n", "", 1, "PASS (1) FAIL (1) skipped (1)", ["1. it works", "   expected 1"]),
    (["tsc"], "a.ts(1,2): error TS1: x\nb.ts(1,2): error TS2: y\n", "", 1, "TypeScript: 2 errors in 2 files", ["a.ts(1,2): error TS1: x", "b.ts(1,2): error TS2: y"]),
    (["env"], "PATH=/a:/b\nAWS_SECRET=x\nHOME=/h\nFOO=1\n", "", 0, "vars=4; shown=3", ["PATH=2 entries", "AWS_SECRET=***", "HOME=/h"]),
    (["find", "."], "./a/x.py\n./b/y.py\n./z\n", "", 0, "3 paths in 3 dirs (2 .py, 1 no-ext)", ["./a/x.py", "./b/y.py", "./z"]),
    (["rg", "x"], HITS, "", 0, "", [f"a:{i}:x" for i in range(25)] + [f"b:{i}:x" for i in range(5)] + ["+ 5 more matches"]),
    (["ls", "-la"], "total 8\ndrwxr-xr-x 2 u g 64 Jan 1 10:00 src\n-rw-r--r-- 1 u g 2048 Jan 1 10:00 a.py\n", "", 0, "Summary: 1 files, 1 dirs (1 .py)", ["src/", "a.py  2.0K"]),
    (["npm", "install"], "added 3 packages\nfunding\n", "", 0, "added 3 packages", ["funding"]),
    (["frob"], "\n".join(map(str, range(50))), "", 0, "50 lines | 139B", [str(i) for i in range(40)] + ["+ 10 more lines"]),
    (["frob"], "", "", 0, "no output", []),
]


@pytest.fixture(scope="module")
def results(spark):
    return run(spark, [c[:4] for c in CASES])


@pytest.mark.parametrize("k", range(len(CASES)), ids=[" ".join(c[0]) for c in CASES])
def test_summary(results, k):
    _, headline, details, _ = results[k]
    assert (headline, details) == (CASES[k][4], CASES[k][5])


def test_modes(spark):
    rows = [(["git", "status"], "## main\n", "", 0), (["frob"], "\n".join("line %d" % i for i in range(200)), "", 0), (["frob"], "", "", 0)]
    data = [(str(i), a, o, e, x) for i, (a, o, e, x) in enumerate(rows)]
    out = output_modes(summarized(classified(spark.createDataFrame(data, SCHEMA)))).withColumn("short", rendered()).orderBy("run_id").collect()
    assert [r["mode"] for r in out] == ["raw_fallback", "compressed", "raw_fallback"]
    assert out[1]["short"].startswith("200 lines | ") and out[1]["short"].endswith("- + 160 more lines\n")


def test_array_helpers_against_plain_python(spark):
    from tracewell.operators.summarize.base import joined_blocks, tallied
    from tracewell.operators.summarize.generic import capped_hits  # its columns need a session

    draw = random.Random(1)
    line = lambda: draw.choice("abcde") + draw.choice(["", ":", ":x"]) + draw.choice(["", "S", "E"])
    df = spark.createDataFrame([([line() for _ in range(n)],) for n in (0, 1, 2, 5, 40, 300, 900)], "a array<string>")
    a = F.col("a")
    for r in df.select("a", tallied(a).alias("t"), capped_hits(a).alias("c"), joined_blocks(a, lambda x: x.endswith("S"), lambda x: x.endswith("E")).alias("b")).collect():
        counts, seen, hits, blocks, on = collections.Counter(r["a"]), collections.Counter(), [], [], False
        for x in r["a"]:
            seen[x.split(":")[0]] += 1
            if seen[x.split(":")[0]] <= 25:
                hits.append(x)
            if x.endswith("S"):
                blocks.append([x])
                on = True
            elif on and not x.endswith("E"):
                blocks[-1].append(x)
            else:
                on = False
        assert [(x["key"], x["n"]) for x in r["t"]] == sorted(counts.items(), key=lambda p: (-p[1], p[0]))
        assert r["c"] == hits[:200] and r["b"] == ["\n".join(b) for b in blocks]


def test_array_helpers_take_long_runs(spark):
    from tracewell.operators.summarize.base import joined_blocks, tallied
    from tracewell.operators.summarize.generic import capped_hits  # its columns need a session

    a = F.transform(F.sequence(F.lit(1), F.lit(100_000)), lambda i: F.concat((i % 5000).cast("string"), F.lit(":x")))
    held = spark.range(1).select(a.alias("a")).select(F.size(tallied(F.col("a"))), F.size(capped_hits(F.col("a"))), F.size(joined_blocks(F.col("a"), lambda x: x.startswith("1"), lambda x: x.startswith("2"))))
    assert list(held.first()) == [5000, 200, 22220]
