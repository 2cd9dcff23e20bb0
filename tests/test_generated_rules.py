"""Rules held against short re-tellings of their text on generated inputs."""

import random
from collections import defaultdict

import pytest

from reviewlake.limits import Limits
from reviewlake.operators import diff as D
from reviewlake.operators import findings as E
from reviewlake.operators import report as R
from reviewlake.operators import scope as C
from reviewlake.schemas import REVIEW_FINDING, SEVERITIES, SOURCES

from .test_properties import edit


# --- findings on files -------------------------------------------------------------------

def drawn_findings(rng, n):
    """Findings over three known files and an unknown one; lines, levels and lengths around every bound."""
    rows = []
    for idx in range(n):
        wild = rng.random() < 0.3
        rows.append(dict(
            review_id=idx % 4, idx=idx, file_path=f"pkg/m{rng.randint(0, 3)}.py", line_number=rng.randint(-1, 12),
            source=rng.choice(SOURCES if not wild else (*SOURCES, "lint", None)), category=rng.choice("uvw") * (rng.choice([1, 128, 129]) if wild else 1),
            severity=rng.choice(SEVERITIES if not wild else (*SEVERITIES, "urgent")), title=rng.choice(["t", "t" * 256, "t" * 257, "", None] if wild else ["t", "s"]),
            description="d" * (rng.choice([1, 4000, 4001]) if wild else 1), suggestion=rng.choice([None, "", "fix", "f" * 4001] if wild else [None, "fix"])))
    return rows


FILES = {(review, f"pkg/m{k}.py"): (4 + 3 * k, [2 * k + 1, 2 * k + 2, 4 + 3 * k]) for review in range(4) for k in range(3)}


def expected_reason(row):
    caps = {"file_path": 1024, "category": 128, "title": 256, "description": 4000}
    sound = (row["line_number"] > 0 and row["source"] in SOURCES and row["severity"] in SEVERITIES
             and all(row[name] is not None and 1 <= len(row[name]) <= cap for name, cap in caps.items())
             and (row["suggestion"] is None or len(row["suggestion"]) <= 4000))
    if not sound:
        return "invalid_schema"
    if (row["review_id"], row["file_path"]) not in FILES:
        return "unknown_file"
    length, added = FILES[row["review_id"], row["file_path"]]
    if row["line_number"] > length:
        return "invalid_line_number"
    return None if row["line_number"] in added else "outside_reviewed_changes"


def runs(lines):
    """The lines as sorted runs of neighbours."""
    out = []
    for line in sorted(lines or ()):
        if out and out[-1][1] == line - 1:
            out[-1] = (out[-1][0], line)
        else:
            out.append((line, line))
    return out


@pytest.fixture(scope="module")
def checked(spark):
    rows = drawn_findings(random.Random(31), 600)
    files = spark.createDataFrame([(r, f, n, runs(a)) for (r, f), (n, a) in FILES.items()],
                                  "review_id long, file_path string, line_count int, added array<struct<first: long, last: long>>")
    return rows, E.validate_findings(spark.createDataFrame(rows, REVIEW_FINDING), files).cache()


def test_first_failing_check_is_the_reason(checked):
    rows, validated = checked
    want = {row["idx"]: expected_reason(row) for row in rows}
    assert {r.idx: r.reason for r in validated.collect()} == want
    assert set(want.values()) == {None, "invalid_schema", "unknown_file", "invalid_line_number", "outside_reviewed_changes"}
    assert {(r.review_id, r["index"], r.reason) for r in E.rejected(validated).collect()} == {
        (row["review_id"], row["idx"], want[row["idx"]]) for row in rows if want[row["idx"]]}


def test_merging_keeps_the_gravest_and_all_origins(checked):
    rows, validated = checked
    groups = defaultdict(list)
    for row in rows:
        if expected_reason(row) is None:
            groups[row["review_id"], row["file_path"], row["line_number"], row["category"]].append(row)
    assert any(len(g) > 2 for g in groups.values())
    merged = R.merge_findings(E.accepted(validated))
    order = lambda x: (SEVERITIES.index(x["severity"]), x["source"], x["title"], x["description"], x["suggestion"] or "", x["idx"])
    got = {(r.review_id, r.file_path, r.line_number, r.category): (r.severity, r.source, r.sources, r.merged, r.first_index) for r in merged.collect()}
    assert got == {k: (min(g, key=order)["severity"], min(g, key=order)["source"], sorted({x["source"] for x in g}), len(g), min(x["idx"] for x in g))
                   for k, g in groups.items()}
    origins = {(r.review_id, r.file_path, r.line_number, r.category): r.original_indices for r in R.provenance(E.accepted(validated)).collect()}
    assert origins == {k: sorted(x["idx"] for x in g) for k, g in groups.items()}
    for r in R.severity_summary(merged).collect():
        best = [min(g, key=order)["severity"] for k, g in groups.items() if k[0] == r.review_id]
        assert (r.total_findings, r.high, r.medium, r.low) == (len(best), *(best.count(s) for s in SEVERITIES))


# --- scope ---------------------------------------------------------------------------------

# One sample of each exclusion, in the order in which they are tested: (part of the path, status, patch).
EXCLUSIONS = [
    ("ignored_directory", [dict(folder=f"src/{d}/deep") for d in (*C.IGNORED_DIRECTORIES, "VENDOR", "Dist")]),
    ("lock_file", [dict(name=n) for n in ("poetry.lock", "any.lock", "some.lock.py", "PIPFILE.LOCK")]),
    ("unsupported_extension", [dict(name=n) for n in ("data.txt", "py", ".py", "x.pyc", "x.py.orig")]),
    ("generated_file", [dict(name=n) for n in ("api_pb2.py", "api_PB2_grpc.py", "m.generated.py")] + [dict(patch=f"+# {m.upper()} x") for m in C.GENERATED_MARKERS]),
    ("removed_file", [dict(status="removed")]),
    ("missing_patch", [dict(patch=None), dict(patch="")]),
    ("binary_patch", [dict(patch="+a\0b"), dict(patch="Binary files differ"), dict(patch="GIT binary patch\nx")]),
    ("max_patch_chars_per_file", [dict(patch="+" + "x" * 60)]),
]


def test_earlier_exclusions_win(spark):
    rng, rows, want = random.Random(5), [], []
    for i, (reason, samples) in enumerate(EXCLUSIONS):
        for sample in samples:
            for later in [{}] + [s for _, group in EXCLUSIONS[i + 1:] for s in rng.sample(group, 1)]:
                file = {"folder": "src/app", "name": "m.py", "status": "modified", "patch": "+x = 1", **later, **sample}
                if reason == "generated_file" and "patch" not in sample:
                    file["patch"] = file["patch"] or "+x"
                rows.append((len(rows), f"{file['folder']}/{file['name']}", file["status"], file["patch"]))
                want.append(reason)
    for name in ("build.py", "a/builder/x.py", "distx/x.PY", "lock.py", "pb2.py"):  # near misses
        rows.append((len(rows), name, "added", "+" + "x" * 49))
        want.append(None)
    frame = spark.createDataFrame(rows, "review_id long, filename string, status string, patch string")
    got = C.scope_reason(frame, Limits(max_patch_chars_per_file=50)).orderBy("review_id").collect()
    assert [(r.filename, r.reason) for r in got] == [(row[1], w) for row, w in zip(rows, want)]


def walk(sizes, most, total):
    """Reasons of items in order, one after the other."""
    taken, used, out = 0, 0, []
    for need, spent in sizes:
        out.append("count" if taken >= most else "total" if used + need > total else None)
        if out[-1] is None:
            taken, used = taken + 1, used + spent
    return out


def test_scope_budget_is_the_walk_for_reviews_of_any_size(spark):
    rng, rows, want = random.Random(12), [], []
    for review in range(90):
        n = 3500 if review == 7 else rng.randint(1, 60)
        names = sorted({f"f{rng.randint(0, 10**6):07}.py" for _ in range(n)})
        sizes = [rng.randint(1, 12 if review % 2 else 45) for _ in names]
        if review == 7:
            sizes = [40] * (len(names) - 40) + sizes[:40]
        reasons = walk([(s, s) for s in sizes], 6, 100)
        want += [(review, n, {"count": "max_files", "total": "max_total_patch_chars", None: None}[r], s) for n, r, s in zip(names, reasons, sizes)]
        rows += [(review, n, "modified", "p" * s) for n, s in zip(names, sizes)]
    rng.shuffle(rows)
    limits = Limits(max_files=6, max_total_patch_chars=100, max_patch_chars_per_file=50)
    frame = C.scope_reason(spark.createDataFrame(rows, "review_id long, filename string, status string, patch string"), limits)
    decided = C.apply_scope_budget(frame, limits).cache()
    assert sorted(map(tuple, decided.collect()), key=str) == sorted(want, key=str)
    documents = C.scope_document(decided, limits).collect()
    listed = defaultdict(int)
    for d in documents:
        listed[d.review_id] += len(d.skipped_files)
    assert all(listed[d.review_id] == d.total_files - d.selected_files for d in documents)
    assert sum(d.review_id == 7 for d in documents) == 4  # pages of a huge review


def test_repeated_files_are_taken_one_by_one(spark):
    rows = [(1, "a.py", "added", "x" * 30)] * 5 + [(1, "b.py", "added", "y" * 10)] * 2
    limits = Limits(max_files=4, max_total_patch_chars=100)
    decided = C.apply_scope_budget(C.scope_reason(spark.createDataFrame(rows, "review_id long, filename string, status string, patch string"), limits), limits)
    got = sorted((r.filename, r.reason or "") for r in decided.collect())
    assert got == [("a.py", "")] * 3 + [("a.py", "max_total_patch_chars")] * 2 + [("b.py", ""), ("b.py", "max_files")]


def test_model_admission_is_the_walk(spark):
    rng, rows, want = random.Random(13), [], []
    limits = Limits(ai_max_files=5, ai_max_diff_chars=50, ai_max_total_input_chars=120, ai_max_retries=2)
    for review in range(60):
        names = sorted({f"f{rng.randint(0, 10**6):07}.{rng.choice(['py', 'py', 'py', 'md'])}" for _ in range(3200 if review == 3 else rng.randint(1, 40))})
        files = [(n, rng.randint(1, 60), rng.randint(1, 45), rng.randint(0, 3)) for n in names]
        own = {n: "ai_unsupported_file" if not n.endswith(".py") else "ai_diff_limit" if chars > 50 else None for n, chars, _, _ in files}
        open_ = [f for f in files if own[f[0]] is None]
        reasons = walk([(cost * 3, cost * tries) for _, _, cost, tries in open_], 5, 120)
        own |= {f[0]: {"count": "ai_file_limit", "total": "ai_total_input_limit", None: None}[r] for f, r in zip(open_, reasons)}
        rows += [(review, *f) for f in files]
        want += [(review, n, cost, tries, own[n]) for n, _, cost, tries in files]
    frame = spark.createDataFrame(rows, "review_id long, filename string, patch_chars int, cost long, attempts int")
    assert sorted(map(tuple, E.admit_model_inputs(frame, limits).collect()), key=str) == sorted(want, key=str)


# --- patches ---------------------------------------------------------------------------------

def errors_of(spark, patches):
    frame = spark.createDataFrame([(i, "f.py", p) for i, p in enumerate(patches)], "review_id long, filename string, patch string")
    return [r.error for r in D.diff_errors(frame).orderBy("review_id").collect()]


def test_damage_to_a_sound_patch(spark):
    """Each kind of damage to the last hunk of a generated patch has its code."""
    rng, patches, want = random.Random(21), [], []
    while len(patches) < 250:
        lines = edit(rng)[0].split("\n")
        heads = [i for i, x in enumerate(lines) if x.startswith("@@ ") and x.endswith(" context")]
        at = heads[-1]
        if lines[-1].startswith("\\ "):
            lines.pop()
        kinds = {"+": "incomplete_diff_hunk", "=": "invalid_diff_counts", "?": "invalid_diff_body", "@": "invalid_diff_hunk", "^": "invalid_diff_body"}
        kind = rng.choice("+=?@^")
        if kind == "+":
            lines.pop()
        elif kind == "=":
            lines.append(rng.choice("+- ") + "extra")
        elif kind == "?":
            lines.insert(at + 1, rng.choice(["", "x", "\\ other remark", "\t"]))
        elif kind == "@":
            lines[at] = rng.choice(["@@", lines[at].replace("+", ""), "@@ -a +1 @@", lines[at].replace(" @@", "")])
        else:
            lines.insert(0, rng.choice(["index 12", "", "+++ b/f.py"]))
        patches.append("\n".join(lines))
        want.append(kinds[kind])
    assert errors_of(spark, patches) == want


def test_headers_with_numbers_of_any_size(spark):
    """No header may stop the job; sizes are compared exactly."""
    rng, patches, want = random.Random(22), [], []
    big = [2**31 - 1, 2**31, 2**63 - 1, 2**63, 10**30, 10**45]
    for n in big:
        patches += [f"@@ -1,{n} +1 @@\n x", f"@@ -{n} +{n} @@\n x", f"@@ -{n},1 +1 @@\n x\n@@ -5 +{n} @@\n x", f"@@ -1 +{n} @@\n x\n@@ -3 +{n - 1} @@\n x"]
        want += ["incomplete_diff_hunk", None, "overlapping_diff_hunks", "overlapping_diff_hunks"]
    assert errors_of(spark, patches) == want
    wild = [f"@@ -{rng.choice([0, 1, *big])},{rng.choice([0, 1, 2, *big])} +{rng.choice([0, 1, *big])},{rng.choice([0, 1, 2, *big])} @@\n" + "\n".join(
        rng.choice("+- ") for _ in range(rng.randint(0, 3))) for _ in range(300)]
    frame = spark.createDataFrame([(i, "f.py", p) for i, p in enumerate(wild)], "review_id long, filename string, patch string")
    assert D.diff_errors(frame).count() == 300
    changed = D.changed_lines(frame)
    assert changed.filter("line <= 0 and side = 'added'").count() == 0
    assert D.hunks(frame).count() == 300
    found = spark.createDataFrame([(i, 0, "f.py", 1, "ai", "c", "low", "t", "d", None) for i in range(300)], REVIEW_FINDING)
    lines = D.added_lines(frame)
    assert E.on_changed_lines(found, lines).count() == len({r.review_id for r in lines.collect() if r.line == 1})


def test_numbers_at_the_end_of_a_file_without_newline(spark):
    rng, rows, want = random.Random(23), [], {}
    for i in range(60):
        patch, sets = edit(rng)
        marker = "\\ No newline at end of file"
        rows.append((i, "f.py", patch if patch.endswith(marker) else f"{patch}\n{marker}"))
        want[i] = sets
    frame = spark.createDataFrame(rows, "review_id long, filename string, patch string")
    got = {i: {"added": set(), "new": set(), "removed": set()} for i in want}
    for r in D.changed_lines(frame).collect():
        got[r.review_id][r.side].add(r.line)
    assert got == want
