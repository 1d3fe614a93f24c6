"""Parsing of generated site responses: a JSON list of files, often fenced or cut off."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetspark.functions.records import computed_once, parsed_doc, parsed_json
from fleetspark.functions.text import python_strip

# Marks of the response format and the files a site needs.
JSON_FENCE = "```json"
FENCE = "```"
FILES_KEY = '"files"'
FILES_OPENING = '"files": ['
ENTRY_BREAK = "},\n    {"
FILES_CLOSING = "\n  ]\n}"
REQUIRED_FILES = [
    "app/[[...page]]/page.tsx", "app/layout.tsx", "app/not-found.tsx",
    "lib/builder.ts", "package.json", "tsconfig.json", "vercel.json",
]
COMPONENT_FOLDER, COMPONENT_SUFFIX = "components/", ".tsx"
EDIT_FILES = {
    "color_palette": ["tailwind.config.ts", "app/globals.css"],
    "content": ["app/page.tsx"],
    "typography": ["tailwind.config.ts", "app/globals.css"],
    "layout": ["app/page.tsx", "tailwind.config.ts"],
    "animation": ["app/page.tsx"],
    "add_section": ["app/page.tsx"],
    "fix_bug": ["app/page.tsx"],
    "update_images": ["app/page.tsx"],
    "seo": ["app/layout.tsx"],
}
EDIT_DEFAULT = ["app/page.tsx"]

LIST_SHAPE = "files: array<struct<path: string, content: string>>"
MAP_SHAPE = "files: map<string, string>"


def json_candidate(text: Column) -> Column:
    """The JSON part of a response: a json fence, else any fence, else the outermost braces."""

    def fenced(mark: str) -> Column:
        after = F.split_part(text, F.lit(mark), F.lit(2))
        return F.split_part(after, F.lit(FENCE), F.lit(1))

    from_brace = F.substring(text, F.instr(text, "{"), F.length(text))
    tail_length = F.length(F.substring_index(from_brace, "}", -1))
    braced = F.left(from_brace, F.length(from_brace) - tail_length)
    found = (
        F.when(text.contains(JSON_FENCE), python_strip(fenced(JSON_FENCE)))
        .when(text.contains(FENCE), python_strip(fenced(FENCE)))
        .when(text.contains("{") & text.contains(FILES_KEY), braced)
    )
    return F.nullif(found, F.lit(""))


def repaired(candidate: Column) -> Column:
    """A cut-off file list closed after its last complete entry; null if there is none."""
    rest = F.length(F.substring_index(candidate, ENTRY_BREAK, -1))
    head = F.left(candidate, F.length(candidate) - rest - len(ENTRY_BREAK))
    usable = candidate.contains(FILES_OPENING) & candidate.contains(ENTRY_BREAK)
    return F.when(usable, F.concat(head, F.lit("}" + FILES_CLOSING)))


def parse_response_files(df: DataFrame, text: str = "response_text", shape: str = LIST_SHAPE) -> DataFrame:
    """Add ``files`` and ``parse_state`` (parsed, repaired, malformed, no_json)."""
    out = computed_once(df, _candidate=json_candidate(F.col(text)))
    out = computed_once(out, _first=parsed_json(F.col("_candidate"), shape))
    # Only a failed parse reaches the second one: its input is null otherwise.
    first = parsed_doc("_first")["files"]
    retry = F.when(first.isNull(), repaired(F.col("_candidate")))
    out = computed_once(out, _second=parsed_json(retry, shape))
    second = parsed_doc("_second")["files"]
    state = (
        F.when(F.col("_candidate").isNull(), "no_json").when(first.isNotNull(), "parsed")
        .when(second.isNotNull(), "repaired").otherwise("malformed")
    )
    out = out.withColumns({"parse_state": state, "files": F.coalesce(first, second)})
    return out.drop("_candidate", "_first", "_second")


def file_paths(files: Column) -> Column:
    return F.transform(files, lambda f: F.coalesce(f["path"], F.lit("")))


def component_names(files: Column) -> Column:
    """Base names of the component files, in file order."""
    inside = F.filter(
        file_paths(files), lambda p: p.startswith(COMPONENT_FOLDER) & p.endswith(COMPONENT_SUFFIX)
    )
    return F.transform(inside, lambda p: F.replace(F.substring_index(p, "/", -1), F.lit(COMPONENT_SUFFIX), F.lit("")))


def missing_files(files: Column) -> Column:
    """Required files that were not generated, in the order of the requirement."""
    return F.array_except(F.array(*[F.lit(p) for p in REQUIRED_FILES]), file_paths(files))


def edit_files(edit_type: Column) -> Column:
    """Files an edit of this type touches; the table is a constant, so no join is needed."""
    pairs = []
    for kind, paths in EDIT_FILES.items():
        pairs += [F.lit(kind), F.array(*[F.lit(p) for p in paths])]
    default = F.array(*[F.lit(p) for p in EDIT_DEFAULT])
    return F.coalesce(F.try_element_at(F.create_map(*pairs), F.coalesce(edit_type, F.lit(""))), default)
