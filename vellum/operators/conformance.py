"""Conformance profiles as a table of rules over one row of facts a document.

``facts`` reads a file into one row: scalars of the catalog and nested arrays of intents, fonts, annotations, embedded files, pages and
structure elements. A rule is a code with the profiles it belongs to, what it looks at (the document, or each item of an array) and
a test in SQL; a profile's rules become one projection, so a document is passed over once whatever their number and nothing is
shuffled. Every run ends with an information row a document.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.sources.pdf import ERRORS, USUAL, File, Limits, Ref, Stream
from vellum.sources.content import columnar, operations


@dataclass(frozen=True)
class Profile:
    """part: of PDF/A or PDF/UA; tagged: level A; text: fonts need a map to Unicode."""

    name: str
    family: str = ""
    part: int = 0
    level: str = ""
    version: str = ""
    tagged: bool = False
    text: bool = False
    transparency: bool = True
    any_files: bool = False
    engineering: bool = False


#: fixed values: the profiles and what they ask for
PROFILES = {p.name: p for p in (
    Profile("PDF 1.7"), Profile("PDF 2.0"),
    Profile("PDF/A-1A", "A", 1, "A", "1.4", True, True, False), Profile("PDF/A-1B", "A", 1, "B", "1.4", transparency=False),
    Profile("PDF/A-2A", "A", 2, "A", "1.7", True, True), Profile("PDF/A-2B", "A", 2, "B", "1.7"), Profile("PDF/A-2U", "A", 2, "U", "1.7", text=True),
    Profile("PDF/A-3A", "A", 3, "A", "1.7", True, True, any_files=True), Profile("PDF/A-3B", "A", 3, "B", "1.7", any_files=True), Profile("PDF/A-3U", "A", 3, "U", "1.7", text=True, any_files=True),
    Profile("PDF/A-4", "A", 4, "", "2.0"), Profile("PDF/A-4E", "A", 4, "E", "2.0", any_files=True, engineering=True), Profile("PDF/A-4F", "A", 4, "F", "2.0", any_files=True),
    Profile("PDF/UA-1", "UA", 1, "", "1.7", text=True), Profile("PDF/UA-2", "UA", 2, "", "2.0", text=True),
)}

INTENT = "struct<identifier:string,profile:boolean,components:int,signature:string,declared:bigint,size:bigint,space:string>"
FONT = "struct<page:int,name:string,found:boolean,embedded:boolean,unicode:boolean>"
NOTE = "struct<page:int,ordinal:int,num:int,subtype:string,flags:int,appearance:boolean,struct_parent:int,contents:string,goes:boolean,ft:string,name:string,alternate:string,in_tree:boolean,objr:boolean>"
FILE = "struct<num:int,name:string,relationship:string,in_tree:boolean,associated:boolean,f:boolean,uf:boolean,stream:boolean,mime:string,params:boolean,size_ok:boolean,sum_ok:boolean,modified:boolean>"
PAGE = "struct<page:int,struct_parents:int,tabs:string,in_tree:boolean,balanced:boolean,loose:boolean>"
ELEMENT = "struct<num:int,role:string,raw:string,has_parent:boolean,points_back:boolean,parent_role:string,kids:array<string>,alt:boolean,lang:string,id_again:boolean,mcid:boolean,page:boolean,scope:string,headers:boolean,row_span:int,col_span:int,times:int,spaced:boolean>"
FACTS = f"page_count int, version string, encrypted boolean, struct_tree boolean, marked boolean, lang string, display_title boolean, title string, xmp string, xmp_subtype string, collection boolean, need_appearances boolean, xfa boolean, actions array<string>, additional_actions int, blends array<int>, soft_masks array<int>, intents array<{INTENT}>, fonts array<{FONT}>, notes array<{NOTE}>, files array<{FILE}>, pages array<{PAGE}>, elements array<{ELEMENT}>, headings array<int>, generic_heading boolean, role_cycles array<string>, unmapped array<string>, parent_tree boolean, next_key int, keys array<int>, repeated_keys array<int>, namespace2 boolean, error string"
PAINT = frozenset("S s f F f* B B* b b* sh Do Tj TJ ' \" BI".split())
#: fixed values: the standard structure types
STANDARD = frozenset("Document DocumentFragment Part Art Sect Div BlockQuote Caption TOC TOCI Index NonStruct Private P H H1 H2 H3 H4 H5 H6 L LI Lbl LBody Table TR TH TD THead TBody TFoot Span Quote Note Reference BibEntry Code Link Annot Ruby RB RT RP Warichu WT WP Figure Formula Form Title FENote Sub Em Strong Aside Artifact".split())


def facts_of(f: File) -> Iterator[tuple]:
    root, text = f.root, f.text
    yes = lambda d, k: f.get(d.get(k)) is True
    number = lambda d, k: x if isinstance(x := f.get(d.get(k)), int) and not isinstance(x, bool) else None
    listed = lambda d, k: x if isinstance(x := f.get(d.get(k)), list) else []
    meta = f.get(root.get("Metadata"))
    xmp = f.decoded(meta).decode("utf-8", "replace") if isinstance(meta, Stream) else None
    form = f.part(root, "AcroForm")
    intents = []
    for x in listed(root, "OutputIntents"):
        d = f.get(x)
        if isinstance(d, dict) and text(d.get("S")) == "GTS_PDFA1":
            s = f.get(d.get("DestOutputProfile"))
            body = f.decoded(s) if isinstance(s, Stream) else b""
            intents.append({"identifier": text(d.get("OutputConditionIdentifier")), "profile": isinstance(s, Stream), "components": number(s.head, "N") if isinstance(s, Stream) else None, "signature": body[36:40].decode("latin-1"), "declared": int.from_bytes(body[:4], "big"), "size": len(body), "space": body[16:20].decode("latin-1")})
    top = f.part(root, "StructTreeRoot")
    keys, again = number_tree(f, top.get("ParentTree"))
    pages, notes, fonts = [], [], []
    for p in f.pages():
        node, index = p["node"], p["page_index"]
        key = number(node, "StructParents")
        balanced, loose, used = page_marks(p["content"])
        pages.append({"page": index, "struct_parents": key, "tabs": text(node.get("Tabs")), "in_tree": key in keys, "balanced": balanced, "loose": loose})
        resources = f.part(p["resources"], "Font")
        for name in used:
            d = f.get(resources.get(name))
            holder = f.part(d, "FontDescriptor") if isinstance(d, dict) else {}
            inner = f.get((listed(d, "DescendantFonts") or [None])[0]) if isinstance(d, dict) else None
            holder = holder or (f.part(inner, "FontDescriptor") if isinstance(inner, dict) else {})
            fonts.append({"page": index, "name": name, "found": isinstance(d, dict), "embedded": isinstance(d, dict) and (text(d.get("Subtype")) == "Type3" or any(k in holder for k in ("FontFile", "FontFile2", "FontFile3"))), "unicode": isinstance(d, dict) and isinstance(f.get(d.get("ToUnicode")), Stream)})
        for k, ref in enumerate(listed(node, "Annots")):
            a = f.get(ref)
            if not isinstance(a, dict):
                continue
            up = lambda key, d=a: next((text(x[key]) for x in ancestry(f, d) if key in x), "")
            own = number(a, "StructParent")
            entry = f.get(keys.get(own)) if own in keys else None
            objr = isinstance(entry, dict) and any(isinstance(x := f.get(o), dict) and x.get("Obj") == ref for o in (entry.get("K") if isinstance(entry.get("K"), list) else [entry.get("K")]))
            notes.append({"page": index, "ordinal": k, "num": ref.num if isinstance(ref, Ref) else None, "subtype": text(a.get("Subtype")), "flags": number(a, "F") or 0, "appearance": isinstance(f.get(f.part(a, "AP").get("N")), (Stream, dict)), "struct_parent": own, "contents": text(a.get("Contents")), "goes": "A" in a or "Dest" in a, "ft": up("FT"), "name": up("T"), "alternate": up("TU"), "in_tree": own in keys, "objr": objr})
    tree, shared = name_tree(f, f.part(root, "Names").get("EmbeddedFiles")), {x.num for x in listed(root, "AF") if isinstance(x, Ref)}
    actions, additional, blends, masks, files = [], 0, [], [], []
    elements: dict[int, dict] = {}
    for num in sorted(k for k, e in f.xref.items() if e[0]):
        x = f.get(Ref(num, 0))
        d = x.head if isinstance(x, Stream) else x
        if not isinstance(d, dict):
            continue
        kind, sub = text(d.get("Type")), text(d.get("Subtype"))
        for holder in (d, f.get(d.get("A")), f.get(d.get("OpenAction"))):
            if isinstance(holder, dict) and kind not in ("StructElem", "OutputIntent") and text(holder.get("S")):
                actions.append(text(holder.get("S")))
        additional += "AA" in d
        if kind == "ExtGState" and (any(float(f.get(d.get(k, 1))) != 1 for k in ("ca", "CA")) or text(d.get("BM")) not in ("", "Normal")):
            blends.append(num)
        if sub == "Image" and "SMask" in d:
            masks.append(num)
        if kind == "Filespec" and "EF" in d:
            ef = f.part(d, "EF")
            s = f.get(ef.get("UF", ef.get("F")))
            params = f.part(s, "Params") if isinstance(s, Stream) else {}
            data = f.decoded(s) if isinstance(s, Stream) else b""
            files.append({"num": num, "name": text(d.get("UF")), "relationship": text(d.get("AFRelationship")), "in_tree": num in tree, "associated": num in shared, "f": bool(text(d.get("F"))), "uf": bool(text(d.get("UF"))), "stream": isinstance(s, Stream), "mime": text(s.head.get("Subtype")) if isinstance(s, Stream) else "", "params": bool(params), "size_ok": number(params, "Size") == len(data), "sum_ok": f.get(params.get("CheckSum")) == hashlib.md5(data).digest(), "modified": bool(text(params.get("ModDate")))})
        if kind == "StructElem":
            elements[num] = d
    roles = {k: text(v) for k, v in f.part(top, "RoleMap").items()}
    rows, levels, generic, cycles, unmapped, space2 = structure(f, top, elements, roles)
    yield len(pages), f.version, f.security is not None, bool(top), yes(f.part(root, "MarkInfo"), "Marked"), text(root.get("Lang")), yes(f.part(root, "ViewerPreferences"), "DisplayDocTitle"), f.info()["Title"], xmp, text(meta.head.get("Subtype")) if isinstance(meta, Stream) else None, "Collection" in root, yes(form, "NeedAppearances"), "XFA" in form, actions, additional, blends, masks, intents, fonts, notes, files, pages, rows, levels, generic, cycles, unmapped, "ParentTree" in top, number(top, "ParentTreeNextKey"), sorted(keys), again, space2


def ancestry(f: File, d: dict) -> Iterator[dict]:
    for _ in range(f.limits.depth):
        yield d
        d = f.get(d.get("Parent"))
        if not isinstance(d, dict) or d.get("Type") == "Page":
            return


def number_tree(f: File, ref) -> tuple[dict[int, object], list[int]]:
    """Keys with their values; keys that come again or do not increase."""
    out, again, last, todo, seen = {}, [], -1, [ref], set()
    while todo:
        ref = todo.pop()
        node = f.get(ref)
        if not isinstance(node, dict) or isinstance(ref, Ref) and ref in seen:
            continue
        if isinstance(ref, Ref):
            seen.add(ref)
        todo += list(reversed(f.get(node.get("Kids")) or []))
        nums = f.get(node.get("Nums")) or []
        for k, v in zip(nums[::2], nums[1::2], strict=False):
            if isinstance(k, int):
                if k in out or k <= last:
                    again.append(k)
                out[k], last = v, max(last, k)
    return out, again


def name_tree(f: File, ref) -> set[int]:
    out, todo, seen = set(), [ref], set()
    while todo:
        ref = todo.pop()
        node = f.get(ref)
        if not isinstance(node, dict) or isinstance(ref, Ref) and ref in seen:
            continue
        if isinstance(ref, Ref):
            seen.add(ref)
        todo += f.get(node.get("Kids")) or []
        out |= {x.num for x in (f.get(node.get("Names")) or [])[1::2] if isinstance(x, Ref)}
    return out


def page_marks(content: bytes) -> tuple[bool, bool, list[str]]:
    """Whether marks are balanced with numbers used once, whether anything is painted outside marks that have a number or are
    artifacts, and the fonts set."""
    open_: list[bool] = []
    numbers, fonts = set(), []
    balanced, loose = True, False
    for op, args in operations(content):
        if op in ("BMC", "BDC"):
            m = re.search(r"/MCID\s*(\d+)", args[-1]) if args and isinstance(args[-1], str) else None
            if m:
                balanced = balanced and int(m[1]) not in numbers
                numbers.add(int(m[1]))
            open_.append(bool(m) or bool(args) and args[0] == "/Artifact")
        elif op == "EMC":
            balanced = balanced and bool(open_)
            open_ = open_[:-1]
        elif op == "Tf" and args and isinstance(args[0], str) and args[0][1:] not in fonts:
            fonts.append(args[0][1:])
        elif op in PAINT:
            loose = loose or not any(open_)
    return balanced and not open_, loose, fonts


def structure(f: File, top: dict, elements: dict[int, dict], roles: dict[str, str]) -> tuple:
    """Rows of the elements, heading levels in reading order, whether plain H occurs, roles whose map runs round, custom roles without one,
    whether the tree names the namespace of version 2."""
    cycles, unmapped = set(), set()

    def standard(role: str) -> str:
        seen = []
        while role and role not in STANDARD:
            if role in seen:
                cycles.add(role)
                return role
            seen.append(role)
            if role not in roles:
                unmapped.add(role)
                return role
            role = roles[role]
        return role

    text = f.text

    def kids(d: dict) -> list:
        k = f.get(d.get("K"))
        return k if isinstance(k, list) else [] if d.get("K") is None else [d["K"]]

    mapped = {n: standard(text(d.get("S"))) for n, d in elements.items()}
    times: dict[int, int] = {}
    below = {n: [k for k in kids(d)] for n, d in elements.items()}
    for own in [kids(top), *below.values()]:
        for k in own:
            if isinstance(k, Ref) and k.num in elements:
                times[k.num] = times.get(k.num, 0) + 1
    ids: dict[str, int] = {}
    rows = []
    for n, d in elements.items():
        up = d.get("P")
        parent = up.num if isinstance(up, Ref) else None
        name = text(d.get("ID"))
        ids[name] = ids.get(name, 0) + 1
        a = f.get(d.get("A"))
        a = next((x for x in (f.get(y) for y in (a if isinstance(a, list) else [a])) if isinstance(x, dict) and text(x.get("O")) == "Table"), {})
        space = f.part(d, "NS")
        rows.append({
            "num": n, "role": mapped[n], "raw": text(d.get("S")), "has_parent": up is not None, "points_back": parent not in elements or Ref(n, 0) in below[parent], "parent_role": mapped.get(parent, "StructTreeRoot"),
            "kids": [mapped[k.num] for k in below[n] if isinstance(k, Ref) and k.num in elements], "alt": bool(text(d.get("Alt")) or text(d.get("ActualText"))), "lang": text(d.get("Lang")), "id_again": bool(name) and ids[name] > 1,
            "mcid": any(isinstance(k, int) for k in below[n]), "page": "Pg" in d, "scope": text(a.get("Scope")), "headers": bool(f.get(a.get("Headers"))), "row_span": f.get(a.get("RowSpan")), "col_span": f.get(a.get("ColSpan")), "times": times.get(n, 0), "spaced": text(space.get("NS")) == "http://iso.org/pdf2/ssn",
        })
    levels, generic, todo, seen = [], False, list(reversed(kids(top))), set()
    while todo:
        k = todo.pop()
        if not isinstance(k, Ref) or k.num not in elements or k.num in seen:
            continue
        seen.add(k.num)
        role = mapped[k.num]
        generic = generic or role == "H"
        if re.fullmatch("H[1-6]", role):
            levels.append(int(role[1]))
        todo += list(reversed(below[k.num]))
    spaces = f.get(top.get("Namespaces")) or []
    return rows, levels, generic, sorted(cycles), sorted(unmapped - cycles), any(text(f.part({"x": x}, "x").get("NS")) == "http://iso.org/pdf2/ssn" for x in spaces)


def facts(files: DataFrame, limits: Limits = USUAL) -> DataFrame:
    """files: key columns and content. A row of facts a file; a file that cannot be read has its error and no facts."""
    return columnar(files, FACTS, lambda data: list(facts_of(File(data, limits))), ERRORS)


@dataclass(frozen=True)
class Rule:
    """test: SQL over the facts (of a document) or over x, an item of items. on: which profiles, SQL-free Python over Profile."""

    code: str
    message: str
    on: str
    test: str
    items: str = ""
    place: str = "''"
    severity: str = "error"


A, UA, TREE = "p.family == 'A'", "p.family == 'UA'", "p.family == 'UA' or p.tagged"
TAG = r"^[A-Za-z0-9]{1,8}(-[A-Za-z0-9]{1,8})*$"
_xmp = lambda tag: f"regexp_extract(xmp, '<{tag}>([^<]*)</{tag}>', 1)"
_dc = lambda tag: f"regexp_extract(xmp, '(?s)<dc:{tag}>.*?<rdf:li[^>]*>([^<]*)</rdf:li>', 1)"
_object, _page = "cast(x.num as string)", "concat('page ', x.page)"

#: fixed values: structure types that stand under certain others only
PARENTS = {
    "TOCI": ["TOC"], "LI": ["L"], "Lbl": ["LI"], "LBody": ["LI"],
    "THead": ["Table"], "TBody": ["Table"], "TFoot": ["Table"], "TR": ["Table", "THead", "TBody", "TFoot"], "TH": ["TR"], "TD": ["TR"],
    "RB": ["Ruby"], "RT": ["Ruby"], "RP": ["Ruby"], "WT": ["Warichu"], "WP": ["Warichu"],
}
_PARENTS = "map(" + ", ".join(f"'{k}', array({', '.join(repr(x) for x in v)})" for k, v in PARENTS.items()) + ")"

RULES = (
    Rule("PDF-PAGE-001", "there is no page", "True", "page_count = 0"),
    Rule("PDFA-ENCRYPT-001", "the file is encrypted", A, "encrypted"),
    Rule("PDFA-VERSION-001", "the version is another", A, "version <> '{p.version}'"),
    Rule("PDFA-OUTPUT-001", "no output intent for PDF/A", A, "size(intents) = 0"),
    Rule("PDFA-OUTPUT-003", "an intent without a profile", A, "not x.profile", "intents"),
    Rule("PDFA-OUTPUT-004", "a profile of other than 1, 3 or 4 components", A, "x.profile and coalesce(x.components not in (1, 3, 4), true)", "intents"),
    Rule("PDFA-OUTPUT-005", "a profile without its signature", A, "x.profile and (x.size < 128 or x.signature <> 'acsp')", "intents"),
    Rule("PDFA-OUTPUT-006", "a profile of another size than it states", A, "x.profile and x.size >= 128 and x.signature = 'acsp' and x.declared <> x.size", "intents"),
    Rule("PDFA-OUTPUT-007", "a profile of another colour space", A, "x.profile and x.size >= 128 and x.signature = 'acsp' and x.components is not null and x.space <> case x.components when 1 then 'GRAY' when 3 then 'RGB ' else 'CMYK' end", "intents"),
    Rule("PDFA-OUTPUT-008", "an intent without an identifier", A, "x.identifier = ''", "intents"),
    Rule("PDFA-OUTPUT-009", "several output intents for PDF/A", A, "size(intents) > 1"),
    Rule("PDFA-COLLECTION-001", "a portfolio", A, "collection"),
    Rule("PDFA-TAGGED-001", "no structure tree", "p.tagged", "not struct_tree"),
    Rule("PDFA-LANG-001", "no language", "p.tagged", "lang = ''"),
    Rule("META-XMP-001", "no metadata stream", "p.family", "xmp is null"),
    Rule("META-XMP-002", "the metadata is of another subtype", "p.family", "xmp is not null and xmp_subtype <> 'XML'"),
    Rule("META-XMP-003", "the metadata is no XMP packet", "p.family", "not (contains(xmp, '<x:xmpmeta') and contains(xmp, '<rdf:RDF'))"),
    Rule("PDFA-METADATA-001", "the metadata names another part", A, _xmp("pdfaid:part") + " <> '{p.part}'"),
    Rule("PDFA-METADATA-002", "the metadata names another level", "p.family == 'A' and p.level != ''", _xmp("pdfaid:conformance") + " <> '{p.level}'"),
    Rule("PDFA-XMP-EXT-001", "properties without their extension schema", A, "contains(xmp, '<pdfuaid:part>') and not (contains(xmp, '<pdfaExtension:schemas>') and contains(xmp, '<pdfaSchema:namespaceURI>http://www.aiim.org/pdfua/ns/id/</pdfaSchema:namespaceURI>') and contains(xmp, '<pdfaSchema:prefix>pdfuaid</pdfaSchema:prefix>') and contains(xmp, '<pdfaProperty:name>part</pdfaProperty:name>'))"),
    Rule("PDFA-XMP-EXT-002", "a revision that the schema lacks", A, "contains(xmp, '<pdfuaid:part>') and contains(xmp, '<pdfuaid:rev>') and not contains(xmp, '<pdfaProperty:name>rev</pdfaProperty:name>')"),
    Rule("FONT-RESOLVE-001", "a font that the page lacks", "p.family", "not x.found", "fonts", "x.name"),
    Rule("PDFA-FONT-002", "a font that is not embedded", "p.family", "x.found and not x.embedded", "fonts", "x.name"),
    Rule("FONT-UNICODE-001", "a font without a map to Unicode", "p.text", "x.found and not x.unicode", "fonts", "x.name"),
    Rule("PDFA-FORM-001", "appearances are left to the viewer", A, "need_appearances"),
    Rule("PDFA-FORM-002", "an XFA form", A, "xfa"),
    Rule("PDFA-ANNOT-001", "an annotation that part 1 forbids", "p.family == 'A' and p.part == 1", "x.subtype in ('FileAttachment', 'Sound', 'Movie', 'Screen', '3D', 'RichMedia')", "notes", _object),
    Rule("PDFA-ANNOT-002", "an annotation that is not printed", A, "(x.flags & 4) = 0", "notes", _object),
    Rule("PDFA-ANNOT-003", "an annotation that is not shown", A, "(x.flags & 35) <> 0", "notes", _object),
    Rule("PDFA-ANNOT-004", "a widget without an appearance", A, "x.subtype = 'Widget' and not x.appearance", "notes", _object),
    Rule("PDFA-ACTION-001", "a forbidden action", A, "x in ('Launch', 'Sound', 'Movie', 'ResetForm', 'ImportData', 'JavaScript', 'Hide', 'SetOCGState', 'Rendition', 'Trans', 'GoTo3DView')", "actions", "x"),
    Rule("PDFA-ACTION-002", "additional actions", A, "additional_actions > 0"),
    Rule("PDFA-AF-001", "embedded files", "p.family == 'A' and not p.any_files", "size(files) > 0"),
    Rule("PDFA-AF-002", "a file without a relationship", A, "x.relationship in ('', 'Unspecified')", "files", _object),
    Rule("PDFA-AF-003", "a file that the name tree lacks", A, "not x.in_tree", "files", _object),
    Rule("PDFA-AF-004", "a file that is not associated", "p.family == 'A' and p.any_files", "not x.associated", "files", _object),
    Rule("PDFA-AF-005", "a file without both names", A, "not (x.f and x.uf)", "files", _object),
    Rule("PDFA-AF-006", "a file without its stream", A, "not x.stream", "files", _object),
    Rule("PDFA-AF-007", "a file without a type", A, "x.stream and x.mime = ''", "files", _object),
    Rule("PDFA-AF-008", "a file without parameters", A, "x.stream and not x.params", "files", _object),
    Rule("PDFA-AF-009", "a file of another size than stated", A, "x.params and not x.size_ok", "files", _object),
    Rule("PDFA-AF-011", "a file without its checksum", A, "x.params and not x.sum_ok", "files", _object),
    Rule("PDFA-AF-012", "a file without a date", A, "x.params and not x.modified", "files", _object),
    Rule("PDFA4F-AF-003", "no proper embedded file", "p.family == 'A' and p.part == 4 and p.level == 'F'", "not exists(files, x -> x.relationship not in ('', 'Unspecified') and x.in_tree and x.associated and x.f and x.uf and x.mime <> '' and x.size_ok and x.sum_ok and x.modified)"),
    Rule("PDFA4E-CONTENT-001", "no engineering content", "p.engineering", "size(files) = 0", severity="warning"),
    Rule("PDFA1-TRANSPARENCY-001", "transparency", "p.family == 'A' and not p.transparency", "true", "blends", "cast(x as string)"),
    Rule("PDFA1-TRANSPARENCY-002", "a soft mask", "p.family == 'A' and not p.transparency", "true", "soft_masks", "cast(x as string)"),
    Rule("PDFUA-VERSION-001", "the version is another", UA, "version <> '{p.version}'"),
    Rule("PDFUA-TAG-001", "no structure tree", UA, "not struct_tree"),
    Rule("PDFUA-MARKED-001", "the file is not marked", UA, "not marked"),
    Rule("PDFUA-LANG-001", "no language", UA, "lang = ''"),
    Rule("PDFUA-TITLE-003", "the title is not displayed", UA, "not display_title"),
    Rule("PDFUA-METADATA-001", "the metadata names another part", UA, _xmp("pdfuaid:part") + " <> '{p.part}'"),
    Rule("PDFUA2-METADATA-002", "the metadata names another revision", "p.family == 'UA' and p.part == 2", _xmp("pdfuaid:rev") + " <> '2024'"),
    Rule("PDFUA-TITLE-001", "no title in both places", UA, "xmp is not null and (title = '' or " + _dc("title") + " = '')"),
    Rule("PDFUA-TITLE-002", "two titles", UA, "title <> '' and " + _dc("title") + " <> '' and title <> " + _dc("title")),
    Rule("PDFUA-LANG-002", "no language in the metadata", UA, _dc("language") + " = ''"),
    Rule("PDFUA-LANG-003", "two languages", UA, _dc("language") + " <> '' and lang <> " + _dc("language")),
    Rule("PDFUA-LANG-004", "the language is no tag", UA, f"xmp is not null and lang <> '' and not rlike(lang, '{TAG}')"),
    Rule("PDFUA-PARENTTREE-001", "no parent tree", TREE, "struct_tree and not parent_tree"),
    Rule("PDFUA-PARENTTREE-002", "no next key", TREE, "struct_tree and parent_tree and next_key is null"),
    Rule("PDFUA-PARENTTREE-013", "keys that do not increase", TREE, "true", "repeated_keys", "cast(x as string)"),
    Rule("PDFUA-PARENTTREE-015", "the next key is in use", TREE, "struct_tree and next_key <= array_max(keys)"),
    Rule("PDFUA-PARENTTREE-016", "a page's key that the parent tree lacks", TREE, "x.struct_parents is not null and not x.in_tree", "if(struct_tree, pages, array())", _page),
    Rule("PDFUA-PARENTTREE-017", "an annotation's key that the parent tree lacks", TREE, "x.subtype <> 'Popup' and x.struct_parent is not null and not x.in_tree", "if(struct_tree, notes, array())", _page),
    Rule("PDFUA2-NS-001", "the namespace of version 2 is not named", "p.family == 'UA' and p.part == 2", "struct_tree and not namespace2"),
    Rule("PDFUA2-NS-003", "an element of another namespace", "p.family == 'UA' and p.part == 2", "not x.spaced", "elements", _object),
    Rule("PDFUA-ROLE-001", "a role that is not mapped", TREE, "true", "unmapped", "x"),
    Rule("PDFUA-ROLE-002", "a role that runs round", TREE, "true", "role_cycles", "x"),
    Rule("PDFUA-STRUCT-001", "an element without a role", TREE, "x.raw = ''", "elements", _object),
    Rule("PDFUA-STRUCT-002", "an element without a parent", TREE, "not x.has_parent", "elements", _object),
    Rule("PDFUA-STRUCT-004", "an element that its parent lacks", TREE, "x.has_parent and not x.points_back", "elements", _object),
    Rule("PDFUA-STRUCT-008", "an element in several places", TREE, "x.times > 1", "elements", _object),
    Rule("PDFUA-LANG-005", "an element's language is no tag", TREE, f"x.lang <> '' and not rlike(x.lang, '{TAG}')", "elements", _object),
    Rule("PDFUA-ALT-001", "a figure without a description", TREE, "x.role in ('Figure', 'Formula') and not x.alt", "elements", _object),
    Rule("PDFUA-ID-001", "an identifier used again", TREE, "x.id_again", "elements", _object),
    Rule("PDFUA-MCID-003", "marked content without a page", TREE, "x.mcid and not x.page", "elements", _object),
    Rule("PDFUA-SEMANTIC-002", "an element beneath the wrong one", TREE, "coalesce(not array_contains(element_at(" + _PARENTS + ", x.role), x.parent_role), false)", "elements", _object),
    Rule("PDFUA-LIST-001", "a list without items", TREE, "x.role = 'L' and not array_contains(x.kids, 'LI')", "elements", _object),
    Rule("PDFUA-LIST-002", "an item without its one body", TREE, "x.role = 'LI' and (size(filter(x.kids, y -> y = 'LBody')) <> 1 or size(filter(x.kids, y -> y = 'Lbl')) > 1)", "elements", _object),
    Rule("PDFUA-TABLE-001", "a header cell that heads nothing", TREE, "x.role = 'TH' and x.scope = '' and not x.headers", "elements", _object),
    Rule("PDFUA-TABLE-002", "a table without rows", TREE, "x.role = 'Table' and size(x.kids) = 0", "elements", _object),
    Rule("PDFUA-TABLE-003", "a row without cells", TREE, "x.role = 'TR' and not array_contains(x.kids, 'TH') and not array_contains(x.kids, 'TD')", "elements", _object),
    Rule("PDFUA-TABLE-004", "a row span that is not positive", TREE, "x.row_span <= 0", "elements", _object),
    Rule("PDFUA-TABLE-005", "a column span that is not positive", TREE, "x.col_span <= 0", "elements", _object),
    Rule("PDFUA-TABLE-006", "a scope that is none", TREE, "x.scope not in ('', 'Row', 'Column', 'Both')", "elements", _object),
    Rule("PDFUA-RUBY-001", "ruby without its parts", TREE, "x.role = 'Ruby' and not (array_contains(x.kids, 'RB') and array_contains(x.kids, 'RT'))", "elements", _object),
    Rule("PDFUA-WARICHU-001", "warichu without its parts", TREE, "x.role = 'Warichu' and not (array_contains(x.kids, 'WT') and array_contains(x.kids, 'WP'))", "elements", _object),
    Rule("PDFUA-HEADING-001", "two kinds of headings", TREE, "generic_heading and size(headings) > 0", severity="warning"),
    Rule("PDFUA-HEADING-002", "the first heading is not of level 1", TREE, "size(headings) > 0 and headings[0] > 1", severity="warning"),
    Rule("PDFUA-HEADING-003", "a heading level is left out", TREE, "x > 0 and headings[x] > headings[x - 1] + 1", "if(size(headings) > 0, sequence(0, size(headings) - 1), array())", "cast(x as string)", "warning"),
    Rule("PDFUA-PAGE-001", "a page without a key", TREE, "x.struct_parents is null", "if(struct_tree, pages, array())", _page),
    Rule("PDFUA-PAGE-002", "a page without the tab order of the structure", TREE, "x.tabs <> 'S'", "if(struct_tree, pages, array())", _page),
    Rule("PDFUA-MCID-001", "marks that do not match", TREE, "not x.balanced", "if(struct_tree, pages, array())", _page),
    Rule("PDFUA-CONTENT-001", "content outside marks", TREE, "x.balanced and x.loose", "if(struct_tree, pages, array())", _page),
    Rule("PDFUA-ANNOT-001", "an annotation without a key", TREE, "x.subtype <> 'Popup' and x.struct_parent is null", "if(struct_tree, notes, array())", _page),
    Rule("PDFUA-ANNOT-002", "an annotation without a description", TREE, "x.subtype not in ('Popup', 'Widget') and x.contents = ''", "if(struct_tree, notes, array())", _page),
    Rule("PDFUA-ANNOT-003", "an annotation that the parent tree does not refer to", TREE, "x.subtype <> 'Popup' and x.struct_parent is not null and not x.objr", "if(struct_tree, notes, array())", _page),
    Rule("PDFUA-ANNOT-004", "an annotation that is not shown", TREE, "x.subtype <> 'Popup' and (x.flags & 35) <> 0", "if(struct_tree, notes, array())", _page),
    Rule("PDFUA-LINK-001", "a link that leads nowhere", TREE, "x.subtype = 'Link' and not x.goes", "if(struct_tree, notes, array())", _page),
    Rule("PDFUA-FORM-001", "a widget without a field type", TREE, "x.subtype = 'Widget' and x.ft = ''", "if(struct_tree, notes, array())", _page),
    Rule("PDFUA-FORM-002", "a widget without a name", TREE, "x.subtype = 'Widget' and x.name = ''", "if(struct_tree, notes, array())", _page),
    Rule("PDFUA-FORM-003", "a widget without another name", TREE, "x.subtype = 'Widget' and x.alternate = ''", "if(struct_tree, notes, array())", _page),
    Rule("PDFUA-FORM-004", "a widget without an appearance", TREE, "x.subtype = 'Widget' and not x.appearance", "if(struct_tree, notes, array())", _page),
)


def rules_of(profile: str) -> list[Rule]:
    p = PROFILES[profile]
    return [r for r in RULES if eval(r.on, {"p": p})]  # noqa: S307  (conditions are the constants above)


def validate(known: DataFrame, profile: str, most: int = 0) -> DataFrame:
    """known: doc_id and facts. doc_id, code, severity, message, location: what each document breaks of a profile, and a row of
    information. most: at most so many issues a document, in the order of the rules (0: all)."""
    p = PROFILES[profile]
    quoted = lambda s: "'" + s.replace("'", "\\'") + "'"
    parts = []
    for r in rules_of(profile):
        issue = f"named_struct('code', {quoted(r.code)}, 'severity', {quoted(r.severity)}, 'message', {quoted(r.message)}, 'location', cast({r.place} as string))"
        test = r.test.replace("{p.version}", p.version).replace("{p.part}", str(p.part)).replace("{p.level}", p.level)
        parts.append(f"transform(filter({r.items}, x -> coalesce({test}, false)), x -> {issue})" if r.items else f"if(coalesce({test}, false), array({issue}), array())")
    parts.append(f"array(named_struct('code', 'VALIDATION-PROFILE', 'severity', 'info', 'message', {quoted(profile)}, 'location', ''))")
    found = F.expr("flatten(array(" + ", ".join(parts) + "))")
    if most:
        found = F.slice(found, 1, most)
    return known.where("error is null").select("doc_id", F.inline(found))
