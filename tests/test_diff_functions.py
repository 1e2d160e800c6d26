"""Golden rows for the diff functions."""

from fixtrace.functions import diff as D

TWO_FILES = "\n".join([
    "commit 1", "", "diff --git a/x.c b/x.c", "new file mode 100644", "index 1..2", "--- a/x.c", "+++ b/x.c",
    "@@ -1,3 +1,4 @@ int main", " keep", "-old", "+new", "--- x", "@@@ -1 +1 @@@",
    "diff --git a/y.c b/y.c", "new file mode 100644", "index 3..4", "@@ -7 +8,2 @@", "+more"])


def test_unified_zero(one):
    assert one(D.unified_zero, TWO_FILES) == "\n".join([
        "commit 1", "", "diff --git a/x.c b/x.c", "new file mode 100644", "index 1..2", "--- a/x.c", "+++ b/x.c",
        "@@ -1,0 +1,0 @@", "-old", "+new", "--- x", "@@@ -1 +1 @@@",
        "diff --git a/y.c b/y.c", "index 3..4", "@@ -7,0 +8,0 @@", "+more"])


def test_unified_zero_without_hunk_and_odd_line_ends(one):
    assert one(D.unified_zero, "a\n b\n") == "a\n b"
    assert one(D.unified_zero, "a\r\n@@ odd\r\n b\r\n+c") == "a\n@@ odd\n+c"
    assert one(D.unified_zero, "") == ""


def test_minimal_diff(one):
    assert one(D.minimal_diff, TWO_FILES) == "\n".join([
        "diff --git a/x.c b/x.c", "@@ -1,3 +1,4 @@ int main", " keep", "-old", "+new", "--- x", "@@@ -1 +1 @@@",
        "diff --git a/y.c b/y.c", "@@ -7 +8,2 @@", "+more"])
    assert one(D.minimal_diff, "text\ndiff --git a/i b/i\nBinary\ndiff --git a/j b/j\n@@ 1\n+x\n") == (
        "diff --git a/i b/i\ndiff --git a/j b/j\n@@ 1\n+x")
    assert one(D.minimal_diff, "nothing here") == ""


def test_file_diffs(one):
    text = "\n".join([
        "diff --git a/a.py b/a.py", "@@ 1", "+first", "diff --git a/no.py b/no.py", "Binary",
        "diff --git a/b.py b/b.py", "@@ 2", "-gone", 'diff --git "a/q" "b/q"', "@@ 3", "+quoted",
        "diff --git a/a.py b/a.py", "@@ 4", "+last"])
    found = [(f["path"], f["text"]) for f in one(D.file_diffs, text)]
    assert found == [("a.py", "@@ 4\n+last"), ("b.py", "@@ 2\n-gone")]
    assert one(D.file_diffs, "") == []
    assert one(D.file_diffs, None) == []


def test_code_version(one):
    text = "@@ 1\n+  a = 1  \n+# comment\n+\n+/* c */\n-  b = 2\n-* star\n c"
    assert one(D.code_version, text, added=True) == "a = 1\n\n"
    assert one(D.code_version, text, added=False) == "b = 2\n"


def test_file_code(one):
    text = "diff --git a/a b/a\n@@ 1\n+x\n-y\ndiff --git a/b b/b\n@@ 2\n+# only a comment"
    found = [(f["path"], f["code"]) for f in one(D.file_code, text, sep="|")]
    assert found == [("a", "x\n|y\n")]


def test_files_and_extensions(one):
    text = "diff --git a/s/x.tar.gz b/x\ndiff --git a/.bashrc b/q\n diff --git a/no b/no\ndiff --git a/Makefile b/M"
    found = [(f["filename"], f["extension"]) for f in one(D.files_and_extensions, text)]
    assert found == [("x.tar.gz", "gz"), (".bashrc", ""), ("Makefile", "")]


def test_hunk_old_lines(one):
    text = "@@ -10,3 +12,4 @@ x\n code -5,6 and -7,8,9\n+ -1 2,3 +4,5"
    assert one(D.hunk_old_lines, text) == [13, 8]


def test_extract_diff(one):
    assert one(D.extract_diff, "head\n diff --git no\ndiff --git a b\n+x\n") == "diff --git a b\n+x"
    assert one(D.extract_diff, "diff --git a b\n+x") == "diff --git a b\n+x"
    assert one(D.extract_diff, "head only") == ""


def patch(*files, head="From 1\nFrom: me\nSubject: [PATCH 1/2] Fix it\n\nlong\n---\n stat"):
    return head + "".join(files)


def file(path, *lines, hunk="@@ -1,2 +1,2 @@"):
    return f"\ndiff --git a/{path} b/{path}\nindex 1..2\n--- a/{path}\n+++ b/{path}\n" + "\n".join([hunk, *lines])


def test_minimise_patch(one):
    text = patch(file("src/a.c", "-old", "+new"), file("Tests/b.c", "+t"), file("c.c", "+   ", " same"))
    assert one(D.minimise_patch, text) == (
        "Commit Message: Fix it\n\nlong\n\na/src/a.c\nb/src/a.c\n@@ -1,2 +1,2 @@\n-old\n+new")


def test_minimise_patch_parts(one):
    text = patch(file("src/a.c", "-old", "+new"), file("Tests/b.c", "+t"), file("c.c", "+   ", " same"))
    found = one(D.minimise_patch, text)
    assert found.startswith("Commit Message: ")
    assert found.endswith("\na/src/a.c\nb/src/a.c\n@@ -1,2 +1,2 @@\n-old\n+new")
    assert "Tests" not in found and "c.c" not in found.replace("src/a.c", "")
    assert "Tests/b.c" in one(D.minimise_patch, text, remove_test=False)


def test_minimise_patch_errors(one):
    assert one(D.minimise_patch, patch(file("a.c", "+ "))) == "PatchMinErrorType.EMPTY_CHANGE"
    assert one(D.minimise_patch, patch(file("test.c", "+x"))) == "PatchMinErrorType.FAIL"
    odd = '\ndiff --git nothing\n@@ -1 +1 @@\n+x'
    assert one(D.minimise_patch, patch(odd)) == "PatchMinErrorType.ODD_FILE"
    assert one(D.minimise_patch, "no files") == "PatchMinErrorType.FAIL"


def test_minimise_patch_file_without_hunk_runs_on(one):
    text = patch("\ndiff --git a/bin b/bin\nBinary files differ", file("a.c", "+x"))
    found = one(D.minimise_patch, text)
    # The two commands are one match, whose paths are the first file's.
    assert "\na/bin\nb/bin\n@@ -1,2 +1,2 @@\n+x" in found and "a/a.c" not in found
