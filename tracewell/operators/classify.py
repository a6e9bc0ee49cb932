"""Which of the known commands a captured run is: a label of family and name, by ordered rules over its arguments."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.functions import argv as A

UNKNOWN = "unknown"
#: Flags that take a value, by tool.
GIT_FLAGS = ("-C", "-c", "--git-dir", "--work-tree")
DOCKER_FLAGS = ("-H", "--host", "--context", "--config")
COMPOSE_FLAGS = (*DOCKER_FLAGS, "-f", "--file", "-p", "--project-name", "--profile", "--env-file", "--project-directory")
KUBE_FLAGS = ("-n", "--namespace", "-c", "--container", "--context", "--selector", "-l", "--field-selector", "--tail", "--since", "-o", "--output", "-f", "--filename", "--kubeconfig")
NPM_FLAGS = ("--prefix", "--cache", "-w", "--workspace")
PNPM_FLAGS = ("--filter", "-C", "--dir")
UV_FLAGS = ("--project", "--directory", "--python")
POETRY_FLAGS = ("-C", "--directory", "--project")
CWD_FLAGS = ("--cwd",)
CARGO_FLAGS = ("--config", "-Z")
GH_FLAGS = ("-R", "--repo", "--hostname")
DOTNET_FLAGS = ("--configuration", "--framework", "--runtime")
#: First positional argument by label.
GIT = ["status", "diff", "log", "branch", "remote", "show", "fetch", "pull", "push", "checkout", "switch", "commit", "add", "clone", "merge", "tag", "reset", "stash"]
DOCKER = ["ps", "images", "logs", "build", "inspect", "pull"]
CARGO = ["build", "test", "clippy", "check", "install", "nextest"]
DOTNET = ["build", "test", "restore", "format"]
GH = ["pr", "issue", "run"]
MODULES = ["pip", "pytest", "ruff", "mypy"]
LINTERS = ["eslint", "biome", "prettier", "golangci-lint"]
GENERIC = ["ls", "find", "rg", "grep", "curl", "wget", "env", "cat", "head", "tail"]
FAMILIES = ["git", "docker", "python", "lint", "test", "node", "rust", "gh", "k8s", "build", "generic"]


#: For each set of flags that take a value the column that holds the positional arguments; () is no flag at all.
WORDS = {flags: f"__words_{k}" for k, flags in enumerate(((), GIT_FLAGS, DOCKER_FLAGS, COMPOSE_FLAGS, KUBE_FLAGS, NPM_FLAGS, PNPM_FLAGS, UV_FLAGS, POETRY_FLAGS, CWD_FLAGS, CARGO_FLAGS, GH_FLAGS, DOTNET_FLAGS))}


def _words(flags: tuple[str, ...]) -> Column:
    return F.col(WORDS[flags])


def _held(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """With more columns, computed once: as a generator's output they aren't copied into what uses them."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))))


def _at(array: Column, place: int) -> Column:
    return F.try_element_at(array, F.lit(place))


def _rest(array: Column, skip: int = 1) -> Column:
    return F.slice(array, skip + 1, F.greatest(F.size(array), F.lit(1)))


def _named(word: Column, names: list[str], prefix: str, middle: str = "") -> Column:
    return F.when(word.isin(names), F.concat(F.lit(f"{prefix}.{middle}"), word))


def _has(args: Column, *words: str) -> Column:
    return F.exists(args, lambda x: x.isin(*words))


def _docker(program: Column, args: Column) -> Column:
    first = _at(_words(DOCKER_FLAGS), 1)
    words = _words(COMPOSE_FLAGS)
    sub = F.when(_at(words, 1) == "compose", _at(words, 2)).otherwise(_at(words, 1))
    compose = F.when(F.size(words) > 0, F.when(sub.isin("logs", "build", "pull"), F.concat(F.lit("docker."), sub)).otherwise(F.lit("docker.compose")))
    return F.when(program == "docker-compose", compose).when((program == "docker") & (first == "compose"), compose).when(program == "docker", _named(first, DOCKER, "docker"))


def _module(args: Column) -> Column:
    """What follows the first -m, in the same argument or the next."""
    at = F.array_position(F.transform(args, lambda x: x.startswith("-m")), F.lit(True)).cast("int")
    joined = F.when(at > 0, F.substring(F.try_element_at(args, at), 3, 1000))
    name = F.when(joined == "", F.try_element_at(args, at + 1)).otherwise(joined)
    return _named(name, MODULES, "python")


def _python(program: Column, args: Column) -> Column:
    def direct(tool: Column) -> Column:
        return F.when(tool.isin("pip", "pip3"), F.lit("python.pip")).when(tool.isin("pytest", "py.test"), F.lit("python.pytest")).when(tool.isin("ruff", "mypy"), F.concat(F.lit("python."), tool))

    def runner(name: str, flags: tuple[str, ...]) -> Column:
        words = _words(flags)
        inner = F.coalesce(direct(_at(words, 2)), F.when(_at(words, 2).isin("python", "python3", "py"), _module(words)))
        return F.coalesce(F.when(_at(words, 1) == "run", inner), F.lit(f"python.{name}"))

    return F.coalesce(
        direct(program),
        F.when(program == "uv", runner("uv", UV_FLAGS)),
        F.when(program == "poetry", runner("poetry", POETRY_FLAGS)),
        F.when(program.isin("python", "python3", "py"), _module(args)),
    )


def _script_runner(program: Column, args: Column, pick) -> Column:
    """pick(words) for what npx, bun, npm, pnpm and yarn run, with or without a word such as exec before it."""
    def run(flags: tuple[str, ...], through: tuple[str, ...], bare: bool = True) -> Column:
        words = _words(flags)
        direct = pick(words) if bare else F.lit(None).cast("string")
        return F.when(_at(words, 1).isin(*through), pick(_rest(words))).otherwise(direct)

    return (
        F.when(program.isin("npx", "bunx"), pick(_words(())))
        .when(program == "npm", run(NPM_FLAGS, ("exec", "x", "run", "run-script")))
        .when(program == "pnpm", run(PNPM_FLAGS, ("exec", "dlx", "run", "run-script")))
        .when(program == "yarn", run(CWD_FLAGS, ("dlx", "run")))
    )


def _lint(program: Column, args: Column) -> Column:
    def pick(words: Column) -> Column:
        return _named(_at(words, 1), LINTERS, "lint")

    # go [global flags] tool [flags] golangci-lint
    text = F.array_join(args, " ")
    go = F.when((program == "go") & text.rlike(r"^(?:(?:-C|-overlay|-modfile|-mod) \S+ |-\S+ )*tool (?:-modfile \S+ |-\S+ )*golangci-lint(?: |$)"), F.lit("lint.golangci-lint"))
    bun = _words(CWD_FLAGS)
    through = F.when((program == "bun") & (_at(bun, 1) == "x"), pick(_rest(bun)))
    return F.coalesce(_named(program, LINTERS, "lint"), go, through, _script_runner(program, args, pick))


def _test(program: Column, args: Column) -> Column:
    def pick(words: Column) -> Column:
        tool = _at(words, 1)
        return F.when(tool.isin("vitest", "jest", "rspec", "minitest"), F.concat(F.lit("test."), tool)).when((tool == "playwright") & (_at(words, 2) == "test"), F.lit("test.playwright"))

    def ruby(rest: Column) -> Column:
        mini = F.exists(rest, lambda x: x.isin("-Itest", "test") | x.endswith("_test.rb"))
        return F.when(_has(rest, "rspec"), F.lit("test.rspec")).when(mini, F.lit("test.minitest"))

    first = _at(_words(()), 1)
    rails = ("rails", "./bin/rails", "bin/rails")
    bundle = F.when(_at(args, 1) == "exec", F.when(_at(args, 2) == "rspec", F.lit("test.rspec")).when(_at(args, 2) == "ruby", ruby(_rest(args, 2))).when(_at(args, 2).isin(*rails) & (_at(args, 3) == "test"), F.lit("test.minitest")))
    bun = _words(CWD_FLAGS)
    bun = F.when(_at(bun, 1).isin("x", "run"), pick(_rest(bun))).otherwise(pick(bun))
    return (
        F.when(program.isin("vitest", "jest", "rspec", "minitest"), F.concat(F.lit("test."), program))
        .when(program.isin("playwright", "go") & (first == "test"), F.concat(F.lit("test."), program))
        .when(program == "bundle", bundle)
        .when(program == "ruby", ruby(args))
        .when(program.isin(*rails) & (first == "test"), F.lit("test.minitest"))
        .when(program == "bun", bun)
        .otherwise(_script_runner(program, args, pick))
    )


def _kube(program: Column, args: Column) -> Column:
    words = _words(KUBE_FLAGS)
    first = _at(words, 1)
    label = F.when((first == "get") & _has(words, "po", "pod", "pods"), F.lit("pods")).when((first == "get") & _has(words, "svc", "service", "services"), F.lit("services")).when(first.isin("logs", "describe", "apply"), first)
    return F.when(program == "kubectl", F.concat(F.lit("k8s.kubectl-"), label))


def _build(program: Column, args: Column) -> Column:
    first = _at(_words(()), 1)
    dotnet = _named(_at(_words(DOTNET_FLAGS), 1), DOTNET, "build", "dotnet-")
    return (
        F.when(program.isin("tsc", "make", "cmake"), F.concat(F.lit("build."), program))
        .when(program.isin("next", "vite") & (first == "build"), F.concat(F.lit("build."), program))
        .when(program.isin("gradle", "gradlew", "./gradlew"), F.lit("build.gradle"))
        .when(program.isin("mvn", "mvnw", "./mvnw"), F.lit("build.maven"))
        .when(program == "dotnet", dotnet)
    )


def excerpt_lines(program: Column, args: Column) -> Column:
    """How many lines a command prints that does nothing but print a range: sed, or numbered lines through sed in a shell; else null."""
    def size(text: Column) -> Column:
        low, high = (F.nullif(F.regexp_extract(text, r"^(\d+),(\d+)p$", k), F.lit("")).try_cast("int") for k in (1, 2))
        return F.when(high >= low, high - low + 1)

    own = _at(F.filter(F.transform(args, size), lambda x: x.isNotNull()), 1)
    sed = F.when(F.exists(args, lambda x: ~x.startswith("-")), own)
    script = A.shell_script(F.concat(F.array(program), args))
    part = F.regexp_extract(script, r"\bsed -n ['\"]?(\d+,\d+p)", 1)
    shell = F.when(F.trim(script).rlike(r"(^| )nl -ba ") & script.contains("sed -n"), size(part))
    return F.when(program == "sed", sed).otherwise(shell)


def _generic(program: Column, args: Column) -> Column:
    excerpt = F.when(program.isin("sed", "sh", "bash", "zsh") & excerpt_lines(program, args).isNotNull(), F.lit("generic.text-excerpt"))
    files = F.when((program == "rg") & _has(args, "--files"), F.lit("generic.rg-files"))
    return F.coalesce(excerpt, files, _named(program, GENERIC, "generic"))


def _rules(program: Column, args: Column) -> Column:
    """The first family that knows the command gives the label."""
    return F.coalesce(
        F.when(program == "git", _named(_at(_words(GIT_FLAGS), 1), GIT, "git")),
        _docker(program, args),
        _python(program, args),
        _lint(program, args),
        _test(program, args),
        F.when(program.isin("npm", "pnpm", "yarn", "bun"), F.concat(F.lit("node."), program)).when(program.isin("npx", "bunx"), F.lit("node.npx")),
        F.when(program == "cargo", _named(_at(_words(CARGO_FLAGS), 1), CARGO, "rust", "cargo-")),
        F.when(program == "gh", _named(_at(_words(GH_FLAGS), 1), GH, "gh")),
        _kube(program, args),
        _build(program, args),
        _generic(program, args),
        F.lit(UNKNOWN),
    )


@functools.cache
def _label(application: str) -> Column:
    """The rules over the held columns, built once for an application."""
    return _rules(F.col("__program"), F.col("__args"))


def classified(commands: DataFrame, argv: str = "argv") -> DataFrame:
    """The runs with label and family. `sh -c` with a simple command counts as that command.

    Only the quote-aware splitting of such scripts needs Python; it gets null, and does nothing, for other runs.
    """
    inner = A.without_env(A.simple_command(A.shell_script(F.col(argv))))
    script = _held(commands, {"__inner": inner})
    simple = F.coalesce(F.size("__inner"), F.lit(0)) > 0
    # the bare range printers are told by the shell's own arguments
    own = F.coalesce(_generic(_at(F.col(argv), 1), _rest(F.col(argv))) == "generic.text-excerpt", F.lit(False))
    target = _held(script, {"__argv": F.when(simple, F.col("__inner")).otherwise(F.col(argv)), "__own": own & ~simple})
    target = _held(target, {"__program": _at(F.col("__argv"), 1), "__args": _rest(F.col("__argv"))})
    target = _held(target, {name: F.expr(A.positional_sql("__args", flags)) for flags, name in WORDS.items()})
    out = _held(target, {"label": F.when(F.col("__own"), F.lit("generic.text-excerpt")).otherwise(_label(commands.sparkSession.sparkContext.applicationId))})
    family = F.when(F.col("label") == UNKNOWN, F.lit("generic")).otherwise(F.substring_index("label", ".", 1))
    return out.select(*[F.col(c) for c in commands.columns if c not in ("label", "family")], "label", family.alias("family"))


# ---- which commands are left to the user's own shell ----

#: Programs and subcommands that are interactive or don't end.
FOLLOW = ["-f", "--follow"]
ALWAYS = ["ssh", "scp", "sftp", "mosh", "top", "htop", "less", "more", "man", "vim", "nvim", "nano", "tmux", "screen", "watch"]
DOCKER_KEPT = ["run", "exec", "attach"]
COMPOSE_KEPT = ["up", "exec", "run", "attach", "watch"]
KUBECTL_KEPT = ["exec", "attach", "port-forward"]
CARGO_KEPT = ["run", "watch"]
JS_KEPT = ["dev", "start", "serve", "watch", "create"]
JS_SCRIPTS_KEPT = ["dev", "start", "serve", "watch"]


def kept_native(argv: Column) -> Column:
    """Whether a command is interactive or long-running and so isn't captured."""
    body = A.without_env(argv)
    program, args = F.regexp_extract(_at(body, 1), r"([^/]*)$", 1), _rest(body)
    plain = F.filter(args, lambda x: ~x.startswith("-"))
    first, second = _at(plain, 1), _at(plain, 2)
    follow = _has(args, *FOLLOW)

    def sub(word: Column, names: list[str]) -> Column:
        return F.when(word == "logs", follow).otherwise(F.coalesce(word.isin(names), F.lit(False)))

    js = F.when(first == "run", second.isin(JS_SCRIPTS_KEPT)).otherwise(first.isin(JS_KEPT))
    python = _has(args, "-i") | ((_at(args, 1) == "-m") & (_at(args, 2) == "http.server")) | (_at(args, 1).endswith("manage.py") & (_at(args, 2) == "runserver"))
    keep = (
        F.when(program.isin(ALWAYS), F.lit(True))
        .when(program == "tail", follow)
        .when((program == "docker") & (first == "compose"), sub(second, COMPOSE_KEPT))
        .when(program == "docker", sub(first, DOCKER_KEPT))
        .when(program == "docker-compose", sub(first, COMPOSE_KEPT))
        .when(program == "kubectl", sub(first, KUBECTL_KEPT))
        .when(program == "cargo", first.isin(CARGO_KEPT))
        .when(program.isin("npm", "pnpm", "yarn", "bun", "npx"), js)
        .when(program.isin("python", "python3"), python)
        .when(program == "node", _has(args, "--watch"))
    )
    return F.coalesce(keep, F.lit(False))

