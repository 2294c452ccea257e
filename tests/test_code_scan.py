import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodeseek.operators import chunking, code_scan

CASES = {
    "rust": r"""use std::fmt;

/// Doc of one.
#[inline]
fn one<'a>(x: &'a str) -> &'a str {
    let s = "
fn in_string() {
";
    let r = r#"
fn in_raw() { " } "#;
    let c = '{'; let d = '\''; let u = '\u{7b}';
    x
}
/* outer /* nested
fn in_comment() {}
*/ still
fn in_comment_too() {}
*/
pub struct Two { a: u8 }
impl Two {
    fn member(&self) {}
    fn other(&self) {}
}
""",
    "javascript": r"""// note
function one() {
  const t = `
function inTemplate() { ${ `
function deeper() {}` + "}" } {
`;
  const p = /[/{]`\//;
  return x / 2 / 3;
}
/*
function inComment() {}
*/
class Two {
  a() { return '}'; }
  b() {}
}
export const three = { f() {} };
""",
    "typescript": r"""@Injectable()
export class One {
  private a = "{";
  go(): void {}
}
interface Two { b: string }
type Three = `
interface InTemplate {`;
const four = 1;
""",
    "java": r'''/** Doc
public class InDoc { */
@Deprecated
public class One {
    String a = """
public class InBlock {
""";
    char b = '{';
    void go() { }
    void stop() { }
}
interface Two { }
''',
    "c": r"""#define OPEN {
#define LONG \
int in_macro(void) {
struct one { int a; };
static const char *s = "\
int in_string(void) {";
/*
int in_comment(void) { */
int two(void) {
    char c = '{';
    return 0;
}
int three(int a,
          int b) {
    return a;
}
""",
    "cpp": r"""namespace one {
int inner(void) { return 1'000'000; }
}
auto s = R"x(
class InRaw {
)" )x";
class Two {
    int a;
    void go();
};
template <class T>
T three(T a) { return a; }
""",
    "go": r"""package main

// Doc of one.
func one() string {
	a := `
func inRaw() {
`
	b := '{'
	return a + "func inString() {"
}

type Two struct {
	a int
}
var three = map[string]int{"{": 1}
""",
}
#: How the definitions begin, with what stands just above them.
WANTED = {
    "rust": ["/// Doc of one.", "/* outer", "impl Two"],
    "javascript": ["// note", "/*\nfunction", "export const three"],
    "typescript": ["@Injectable", "interface Two", "type Three", "const four"],
    "java": ["/** Doc", "interface Two"],
    "c": ["#define OPEN", "#define LONG", "struct one", "/*\nint in_comment", "int three"],
    "cpp": ["namespace one", "class Two", "template <class"],
    "go": ["// Doc of one.", "type Two", "var three"],
}
INSIDE = re.compile(r"(?m)^.*\b[iI]n_?(?:string|raw|comment_too|comment|macro|Template|Raw|Comment|Doc|Block|String)\b")


def found_in(language, text):
    return code_scan.places(text, language, chunking.DEFINITION[language])


@pytest.mark.parametrize("language", sorted(CASES))
def test_definitions_are_found_and_none_inside_strings_or_comments(language):
    text = CASES[language]
    found = found_in(language, text)
    assert [text[p : p + len(w)] for w, p in zip(WANTED[language], found.definitions)] == WANTED[language] and len(found.definitions) == len(WANTED[language])
    inside = {m.start() for m in INSIDE.finditer(text) if not m.group().lstrip().startswith("return")}
    assert inside and not inside & {*found.definitions, *found.members, *found.lines}


@pytest.mark.parametrize("language", sorted(CASES))
def test_a_definition_that_fits_is_in_one_piece(language):
    text = CASES[language].strip()
    spans = chunking.split(text, chunking.levels_for("code", language, text), 40)
    assert "".join("".join(text[a:b].split()) for a, b in spans) == "".join(text.split())
    starts = found_in(language, text).definitions
    for a, b in zip(starts, [*starts[1:], len(text)]):
        if chunking.count_words(text[a:b]) <= 40:
            assert any(x <= a and a + len(text[a:b].rstrip()) <= y for x, y in spans)


def test_members_are_cut_in_large_definitions():
    text = "class A {\n" + "".join(f"    void m{i}() {{\n        go({i});\n    }}\n" for i in range(30)) + "}\n"
    spans = chunking.split(text, chunking.levels_for("code", "java", text), 60)
    assert all(text[a:b].lstrip().startswith(("class A", "void m", "}")) for a, b in spans) and len(spans) > 4


@settings(max_examples=150, deadline=None)
@given(st.sampled_from(sorted(CASES)), st.text(alphabet="ab{}()[]\"'`/*\\\n#$ r!<>", max_size=80))
def test_any_text_is_scanned_and_kept(language, text):
    found = found_in(language, text)
    assert found.lines[0] == 0 and all(0 <= p <= len(text) for p in [*found.definitions, *found.members, *found.lines])
    text = text.strip()
    spans = chunking.split(text, chunking.levels_for("code", language, text), 3)
    assert "".join("".join(text[a:b].split()) for a, b in spans) == "".join(text.split())
