"""Files from rows: documents with outlines, labels, annotations, fields, images, attachments, metadata, signatures and passwords.

``write_documents`` takes a row a document whose columns (all optional but doc_id and pages) describe it; ``annotate`` and ``revise``
add a revision to files. Work is done a document at a time over Arrow batches; a document is one value.

pages: array of (content, rotation, tabs, struct_parents, form); info: map; lang, xmp, version: string; marked, display_title: boolean;
outlines: array of (title, depth, page); labels: array of (first_page, style, prefix, start_number); annotations: array of (page,
subtype, l, b, r, t, contents, title, uri, dest_page, flags, appearance, action, struct_parent); fields: array of (name, ft, ff, v, page, l, b, r, t), dots in names
make a tree; attachments: array of (name, mime, relationship, data); images: array of (page, width, height, space, data, l, b, r, t);
intent: (identifier, components, profile); fonts: array of (embedded, unicode); elements: array of (role, parent, alt); roles: map;
owner, user: passwords; signer: a name, for a signature whose contents state the digest of the file.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from vellum.sources.pdf import File, Limits, Name, PdfError, Raw, Ref, Stream, append_revision, assemble, dump

BOX = [0, 0, 612, 792]
#: a signature's contents: room for a digest with the attribute around it
DIGEST_HEAD, ROOM = bytes.fromhex("302F06092A864886F70D01090431220420"), 64


def rect(x: dict) -> list[float]:
    return [float(x.get(k) or 0) for k in "lbrt"]


class Graph:
    """Objects under numbers as they are added."""

    def __init__(self) -> None:
        self.objects: dict[int, object] = {}

    def add(self, x) -> Ref:
        self.objects[len(self.objects) + 1] = x
        return Ref(len(self.objects), 0)

    def stream(self, data: bytes, head: dict | None = None, pack: bool = True) -> Ref:
        return self.add(Stream({**(head or {}), "Filter": Name("FlateDecode")}, zlib.compress(data)) if pack else Stream(dict(head or {}), data))


def outline_tree(g: Graph, rows: list[dict], pages: list[Ref]) -> Ref:
    """Entries in order with their depths; one that is deeper than its predecessor's child becomes that child."""
    root: dict = {"Type": Name("Outlines")}
    top = g.add(root)
    open_: list[tuple[Ref, dict]] = [(top, root)]
    for x in rows:
        deep = min(max(0, int(x.get("depth") or 0)), len(open_) - 1)
        del open_[deep + 1 :]
        parent, head = open_[deep]
        node: dict = {"Title": x.get("title") or "", "Parent": parent}
        if x.get("page") is not None and 0 <= x["page"] < len(pages):
            node["Dest"] = [pages[x["page"]], Name("Fit")]
        ref = g.add(node)
        if "Last" in head:
            node["Prev"] = head["Last"]
            g.objects[head["Last"].num]["Next"] = ref
        head.setdefault("First", ref)
        head["Last"], head["Count"] = ref, head.get("Count", 0) + 1
        open_.append((ref, node))
    return top


def annotation(g: Graph, x: dict, pages: list[Ref], parent: Ref | None = None) -> dict:
    out: dict = {"Type": Name("Annot"), "Subtype": Name(x.get("subtype") or "Text"), "Rect": rect(x), "F": 4 if x.get("flags") is None else int(x["flags"])}
    for key, name in (("contents", "Contents"), ("title", "T"), ("subject", "Subj")):
        if x.get(key) is not None:
            out[name] = x[key]
    if x.get("uri"):
        out["A"] = {"S": Name("URI"), "URI": x["uri"]}
    elif x.get("action"):
        out["A"] = {"S": Name(x["action"])}
    if x.get("dest_page") is not None and 0 <= x["dest_page"] < len(pages):
        out["Dest"] = [pages[x["dest_page"]], Name("Fit")]
    if x.get("struct_parent") is not None:
        out["StructParent"] = int(x["struct_parent"])
    if x.get("appearance"):
        out["AP"] = {"N": g.stream(appearance(x), {"Type": Name("XObject"), "Subtype": Name("Form"), "BBox": [0.0, 0.0, out["Rect"][2] - out["Rect"][0], out["Rect"][3] - out["Rect"][1]]})}
    return out


def appearance(x: dict) -> bytes:
    """What a widget or note shows in its box: its text in one line over a frame."""
    l, b, r, t = rect(x)
    text = dump((x.get("v") or x.get("contents") or "").encode("latin-1", "replace"))
    return b"q 0 0 %g %g re W n BT /F1 %g Tf 2 %g Td " % (r - l, t - b, max(4.0, (t - b) * 0.7), (t - b) * 0.2) + text + b" Tj ET Q"


def field_tree(g: Graph, rows: list[dict], pages: list[Ref], annots: list[list[Ref]]) -> list[Ref]:
    roots: list[Ref] = []
    inner: dict[str, Ref] = {}
    for x in rows:
        parts = (x.get("name") or "").split(".")
        parent = None
        for k in range(1, len(parts)):
            path = ".".join(parts[:k])
            if path not in inner:
                node: dict = {"T": parts[k - 1], "Kids": []}
                inner[path] = g.add(node)
                if parent is None:
                    roots.append(inner[path])
                else:
                    node["Parent"] = parent
                    g.objects[parent.num]["Kids"].append(inner[path])
            parent = inner[path]
        leaf = {**annotation(g, {**x, "subtype": "Widget"}, pages), "T": parts[-1], "FT": Name(x.get("ft") or "Tx")}
        leaf.pop("Contents", None)
        if x.get("ff") is not None:
            leaf["Ff"] = int(x["ff"])
        if x.get("v") is not None:
            leaf["V"] = Name(x["v"]) if leaf["FT"] == "Btn" else x["v"]
        if parent is not None:
            leaf["Parent"] = parent
        ref = g.add(leaf)
        if parent is None:
            roots.append(ref)
        else:
            g.objects[parent.num]["Kids"].append(ref)
        page = x.get("page")
        if page is not None and 0 <= page < len(pages):
            annots[page].append(ref)
    return roots


def build_document(x: dict) -> bytes:
    """A file from a row's values."""
    g, catalog, tree = Graph(), {"Type": Name("Catalog")}, {"Type": Name("Pages"), "MediaBox": BOX}
    root, parent = g.add(catalog), g.add(tree)
    catalog["Pages"] = parent
    fonts = {"F1": g.add({"Type": Name("Font"), "Subtype": Name("Type1"), "BaseFont": Name("Helvetica"), "FirstChar": 0, "LastChar": 255, "Widths": [500] * 256})}
    for k, f in enumerate(x.get("fonts") or []):
        d: dict = {"Type": Name("Font"), "Subtype": Name("TrueType"), "BaseFont": Name(f"Own{k}")}
        if f.get("embedded"):
            d["FontDescriptor"] = {"Type": Name("FontDescriptor"), "FontFile2": g.stream(b"\0\1\0\0")}
        if f.get("unicode"):
            d["ToUnicode"] = g.stream(b"1 beginbfchar <41> <0041> endbfchar")
        fonts[f"T{k}"] = g.add(d)
    spec = x.get("pages") or []
    pages = [g.add({"Type": Name("Page"), "Parent": parent}) for _ in spec]
    tree.update({"Kids": pages, "Count": len(pages)})
    annots: list[list[Ref]] = [[] for _ in pages]
    for a in x.get("annotations") or []:
        if 0 <= (a.get("page") or 0) < len(pages):
            annots[a.get("page") or 0].append(g.add(annotation(g, a, pages)))
    images: list[dict[str, Ref]] = [{} for _ in pages]
    paint: list[bytes] = [b"" for _ in pages]
    for k, i in enumerate(x.get("images") or []):
        if not 0 <= (i.get("page") or 0) < len(pages):
            continue
        p, (l, b, r, t) = i.get("page") or 0, rect(i)
        images[p][f"Im{k}"] = g.stream(bytes(i.get("data") or b""), {"Type": Name("XObject"), "Subtype": Name("Image"), "Width": int(i["width"]), "Height": int(i["height"]), "BitsPerComponent": 8, "ColorSpace": Name(i.get("space") or "DeviceGray")})
        paint[p] += b"\nq %g 0 0 %g %g %g cm /Im%d Do Q" % (r - l, t - b, l, b, k)
    fields = list(x.get("fields") or [])
    if x.get("signer"):
        fields.append({"name": "Signature", "ft": "Sig"})
    if fields:
        catalog["AcroForm"] = {"Fields": field_tree(g, fields, pages, annots)}
    for k, (p, ref) in enumerate(zip(spec, pages, strict=True)):
        node = g.objects[ref.num]
        body = p.get("content") or b""
        body = body.encode("latin-1", "replace") if isinstance(body, str) else bytes(body)
        objects = dict(images[k])
        if p.get("form") is not None:
            objects["Fm"] = g.stream(p["form"].encode("latin-1", "replace"), {"Type": Name("XObject"), "Subtype": Name("Form"), "BBox": BOX})
            paint[k] += b"\n/Fm Do"
        node.update({"Contents": g.stream(body + paint[k]), "Resources": {"Font": fonts, **({"XObject": objects} if objects else {})}})
        if p.get("rotation"):
            node["Rotate"] = int(p["rotation"])
        if p.get("tabs"):
            node["Tabs"] = Name(p["tabs"])
        if p.get("struct_parents") is not None:
            node["StructParents"] = int(p["struct_parents"])
        if annots[k]:
            node["Annots"] = annots[k]
    if x.get("outlines"):
        catalog["Outlines"] = outline_tree(g, x["outlines"], pages)
    if x.get("labels"):
        nums: list = []
        for y in sorted(x["labels"], key=lambda y: y["first_page"]):
            d = {k: v for k, v in (("S", Name(y["style"]) if y.get("style") else None), ("P", y.get("prefix")), ("St", y.get("start_number"))) if v is not None}
            nums += [int(y["first_page"]), d]
        catalog["PageLabels"] = g.add({"Nums": nums})
    if x.get("xmp") is not None:
        catalog["Metadata"] = g.stream(x["xmp"].encode(), {"Type": Name("Metadata"), "Subtype": Name("XML")}, pack=False)
    if x.get("attachments"):
        names: list = []
        for a in sorted(x["attachments"], key=lambda a: a["name"]):
            data = bytes(a.get("data") or b"")
            body = g.stream(data, {"Type": Name("EmbeddedFile"), **({"Subtype": Name(a["mime"])} if a.get("mime") else {}), "Params": {"Size": len(data), "CheckSum": hashlib.md5(data).digest()}})
            names += [a["name"], g.add({"Type": Name("Filespec"), "F": a["name"], "UF": a["name"], **({"AFRelationship": Name(a["relationship"])} if a.get("relationship") else {}), "EF": {"F": body}})]
        catalog["Names"] = {"EmbeddedFiles": g.add({"Names": names})}
        catalog["AF"] = names[1::2]
    if x.get("intent") is not None:
        i = x["intent"]
        catalog["OutputIntents"] = [{"Type": Name("OutputIntent"), "S": Name("GTS_PDFA1"), **({"OutputConditionIdentifier": i["identifier"]} if i.get("identifier") else {}), **({"DestOutputProfile": g.stream(bytes(i["profile"]), {"N": int(i["components"])})} if i.get("profile") is not None else {})}]
    if x.get("elements"):
        top: dict = {"Type": Name("StructTreeRoot"), "K": [], "ParentTree": g.add({"Nums": []}), "ParentTreeNextKey": 0}
        if x.get("roles"):
            top["RoleMap"] = {k: Name(v) for k, v in dict(x["roles"]).items()}
        catalog["StructTreeRoot"] = ref = g.add(top)
        nodes: list[Ref] = []
        for e in x["elements"]:
            up = nodes[e["parent"]] if e.get("parent") is not None and 0 <= e["parent"] < len(nodes) else ref
            node = {"Type": Name("StructElem"), "P": up, "K": [], **({"S": Name(e["role"])} if e.get("role") else {}), **({"Alt": e["alt"]} if e.get("alt") else {})}
            nodes.append(g.add(node))
            g.objects[up.num]["K"].append(nodes[-1])
    if x.get("marked") is not None:
        catalog["MarkInfo"] = {"Marked": bool(x["marked"])}
    if x.get("lang") is not None:
        catalog["Lang"] = x["lang"]
    if x.get("display_title") is not None:
        catalog["ViewerPreferences"] = {"DisplayDocTitle": bool(x["display_title"])}
    trailer: dict = {"Root": root}
    if x.get("info"):
        trailer["Info"] = g.add({k: v for k, v in dict(x["info"]).items() if v is not None})
    if x.get("signer"):
        leaf = next(n for n, o in g.objects.items() if isinstance(o, dict) and o.get("FT") == "Sig")
        head = dump({"Type": Name("Sig"), "Filter": Name("Adobe.PPKLite"), "SubFilter": Name("adbe.pkcs7.detached"), "Name": x["signer"]})[:-2]
        g.objects[leaf]["V"] = g.add(Raw(head + b" /ByteRange [0 %10d %10d %10d] /Contents <" % (0, 0, 0) + b"0" * (2 * ROOM) + b">>>"))
    secret = None if x.get("owner") is None and x.get("user") is None else ((x.get("user") or "").encode(), (x.get("owner") or "").encode())
    data = assemble(g.objects, trailer, x.get("version") or "1.7", secret)
    return signed(data) if x.get("signer") else data


def signed(data: bytes) -> bytes:
    """The ranges around a signature's contents filled in, and the contents with the digest of what lies in them."""
    m = re.search(rb"/ByteRange \[0 +0 +0 +0\] /Contents <(0+)>", data)
    a, b = m.start(1) - 1, m.end(1) + 1
    ranges = b"/ByteRange [0 %10d %10d %10d]" % (a, b, len(data) - b)
    data = data[: m.start()] + ranges + data[m.start() + len(ranges) :]
    digest = hashlib.sha256(data[:a] + data[b:]).digest()
    contents = (DIGEST_HEAD + digest).ljust(ROOM, b"\0").hex().upper().encode()
    return data[: a + 1] + contents + data[b - 1 :]


def _map_documents(df: DataFrame, build: Callable[[dict], bytes], keep: list[str]) -> DataFrame:
    schema = df.select(*keep).schema.add("content", "binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # a document's row may be large, its file is given out with a few others
            for k in range(0, batch.num_rows, 64):
                part = batch.slice(k, 64)
                files = [build(row) for row in part.to_pylist(maps_as_pydicts="lossy")]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(files, pa.binary())], names=schema.names)

    return df.mapInArrow(run, schema)


def spread(rows: DataFrame, key: str) -> DataFrame:
    """Narrow rows that each become a file, dealt out by key: a small table is one or two partitions, while its files are work for all cores.
    Partitions are asked for by number, so adaptive execution leaves them as many as they are."""
    spark = rows.sparkSession
    return rows.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 8 * spark.sparkContext.defaultParallelism), key)


def write_documents(specs: DataFrame) -> DataFrame:
    """doc_id, content."""
    return _map_documents(specs, build_document, ["doc_id"])


def annotate(files: DataFrame, annotations: DataFrame) -> DataFrame:
    """files: doc_id, content; annotations: doc_id, page_index, subtype, rect (l, b, r, t), contents. The files with a revision that adds
    them to their pages; a file without any stays byte for byte."""
    from pyspark.sql import functions as F

    own = annotations.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page_index", F.col("rect.t").alias("high"), F.col("rect.l").alias("l"), F.col("rect.b").alias("b"), F.col("rect.r").alias("r"), F.col("rect.t").alias("t"), "subtype", "contents"))).alias("added"))

    def build(row: dict) -> bytes:
        data = row["content"]
        if not row["added"]:
            return data
        f, changed = File(data), {}
        pages = list(f.pages())
        g = Graph()
        top = int(f.trailer["Size"])
        for x in row["added"]:
            page = pages[x["page_index"]]
            node = changed.setdefault(page["num"], {**page["node"], "Annots": list(f.get(page["node"].get("Annots")) or [])})
            changed[top] = annotation(g, x, [])
            node["Annots"].append(Ref(top, 0))
            top += 1
        return append_revision(data, changed)

    return _map_documents(files.join(own, "doc_id", "left"), build, ["doc_id"])


def revise(files: DataFrame, change: Callable[[dict, File], dict[int, object]]) -> DataFrame:
    """Files with a revision of the objects that change(row, file) gives; none: byte for byte."""
    keep = [c for c in files.columns if c != "content"]

    def build(row: dict) -> bytes:
        changed = change(row, File(row["content"]))
        return append_revision(row["content"], changed) if changed else row["content"]

    return _map_documents(files, build, keep)


def _drawn(f: File, page: dict, refs: list, top: int) -> tuple[dict[int, object], list[Ref]]:
    """The page with these annotations' appearances in its content and the annotations gone; a new stream from number top on."""
    node = dict(page["node"])
    resources = dict(f.get(page["resources"]) or {})
    objects = dict(f.get(resources.get("XObject")) or {})
    body, gone = b"", []
    for k, ref in enumerate(refs):
        a = f.get(ref)
        n = f.part(a, "AP").get("N")
        if isinstance(f.get(n), Stream):
            l, b = (float(f.get(x)) for x in f.get(a["Rect"])[:2])
            objects[f"Fl{k}"] = n
            body += b"\nq 1 0 0 1 %g %g cm /Fl%d Do Q" % (l, b, k)
            gone.append(ref)
    contents = f.get(node.get("Contents"))
    node["Contents"] = [*(contents if isinstance(contents, list) else [node["Contents"]] if "Contents" in node else []), Ref(top, 0)]
    node["Resources"] = {**resources, "XObject": objects}
    node["Annots"] = [x for x in f.get(node.get("Annots")) or [] if x not in gone]
    return {page["num"]: node, top: Stream({}, body)}, gone


def flatten(files: DataFrame, widgets: bool = True, others: bool = True) -> DataFrame:
    """Appearances of form fields, of other annotations, or both drawn into the pages; what is drawn is no annotation or field any more."""

    def change(row: dict, f: File) -> dict[int, object]:
        changed, top, done = {}, int(f.trailer["Size"]), []
        for page in f.pages():
            refs = [r for r in f.get(page["node"].get("Annots")) or [] if isinstance(x := f.get(r), dict) and (widgets if x.get("Subtype") == "Widget" else others)]
            if refs:
                new, gone = _drawn(f, page, refs, top)
                if gone:
                    changed.update(new)
                    done += gone
                    top += 1
        form = f.part(f.root, "AcroForm")
        if form and done:
            left = [x for x in f.get(form.get("Fields")) or [] if any(k not in done for k in leaves(f, x))]
            changed[f.trailer["Root"].num] = {**f.root, "AcroForm": {**form, "Fields": left}}
        return changed

    return revise(files, change)


def leaves(f: File, ref) -> list:
    todo, out, seen = [ref], [], set()
    while todo:
        x = todo.pop()
        if isinstance(x, Ref) and x in seen:
            continue
        seen.add(x)
        kids = f.get((f.get(x) or {}).get("Kids")) if isinstance(f.get(x), dict) else None
        if kids:
            todo += kids
        else:
            out.append(x)
    return out


def stamp(files: DataFrame, text: str, x: float = 72, y: float = 72, size: float = 24) -> DataFrame:
    """A text on every page, in a stream after its own."""
    body = b"q BT /F1 %g Tf 1 0 0 1 %g %g Tm " % (size, x, y) + dump(text.encode("latin-1", "replace")) + b" Tj ET Q"

    def change(row: dict, f: File) -> dict[int, object]:
        top = int(f.trailer["Size"])
        changed: dict[int, object] = {top: Stream({}, body)}
        for page in f.pages():
            contents = f.get(page["node"].get("Contents"))
            own = contents if isinstance(contents, list) else [page["node"]["Contents"]] if "Contents" in page["node"] else []
            changed[page["num"]] = {**page["node"], "Contents": [*own, Ref(top, 0)]}
        return changed

    return revise(files, change)


def resave(files: DataFrame, deduplicate: bool = True) -> DataFrame:
    """Files written anew: what the trailer reaches, breadth first, under dense numbers; equal streams once."""
    keep = [c for c in files.columns if c != "content"]

    def build(row: dict) -> bytes:
        f = File(row["content"])
        found, order, first = {}, [], {}
        todo = [x for x in f.trailer.values() if isinstance(x, Ref)]
        while todo:
            ahead = []
            for ref in todo:
                if ref in found:
                    continue
                x = f.get(ref)
                key = (dump(x.head), x.raw) if deduplicate and isinstance(x, Stream) else None
                if key is not None and key in first:
                    found[ref] = found[first[key]]
                    continue
                if key is not None:
                    first[key] = ref
                found[ref] = len(order) + 1
                order.append(x)
                ahead += references(x)
            todo = ahead
        objects = {k + 1: renumbered(x, found) for k, x in enumerate(order)}
        return assemble(objects, renumbered({k: v for k, v in f.trailer.items() if k in ("Root", "Info", "ID")}, found), f.version)

    return _map_documents(files, build, keep)


def references(x) -> list[Ref]:
    if isinstance(x, Ref):
        return [x]
    parts = x.head.values() if isinstance(x, Stream) else x.values() if isinstance(x, dict) else x if isinstance(x, list) else ()
    return [r for p in parts for r in references(p)]


def renumbered(x, numbers: dict[Ref, int]):
    if isinstance(x, Ref):
        return Ref(numbers[x], 0) if x in numbers else None
    if isinstance(x, Stream):
        return Stream(renumbered(x.head, numbers), x.raw)
    if isinstance(x, dict):
        return {k: renumbered(v, numbers) for k, v in x.items()}
    return [renumbered(v, numbers) for v in x] if isinstance(x, list) else x


def protect(files: DataFrame, user: str, owner: str, password: str = "", permissions: int = -44) -> DataFrame:
    """Files written anew under new passwords; password opens what is locked already. A file that it does not open is an error."""
    return _map_documents(files, lambda row: _rewritten(row["content"], password.encode(), (user.encode(), owner.encode()), permissions), [c for c in files.columns if c != "content"])


def unprotect(files: DataFrame, password: str) -> DataFrame:
    """Files written anew without a password."""
    return _map_documents(files, lambda row: _rewritten(row["content"], password.encode(), None, -1), [c for c in files.columns if c != "content"])


def _rewritten(data: bytes, password: bytes, new: tuple[bytes, bytes] | None, permissions: int) -> bytes:
    f = File(data, Limits(password=password))
    if not f.authenticated:
        raise PdfError("the password does not open the file")
    objects = {n: f.get(Ref(n, 0)) for n, e in f.xref.items() if e[0] and n != getattr(f, "locked", None)}
    return assemble(objects, {k: v for k, v in f.trailer.items() if k in ("Root", "Info")}, f.version, new, permissions)


def sign(files: DataFrame, signer: str) -> DataFrame:
    """Files with a signature field in a revision, its contents stating the digest of all the rest."""

    def build(row: dict) -> bytes:
        f = File(row["content"])
        top = int(f.trailer["Size"])
        form = f.part(f.root, "AcroForm")
        head = dump({"Type": Name("Sig"), "Filter": Name("Adobe.PPKLite"), "SubFilter": Name("adbe.pkcs7.detached"), "Name": signer})[:-2]
        value = Raw(head + b" /ByteRange [0 %10d %10d %10d] /Contents <" % (0, 0, 0) + b"0" * (2 * ROOM) + b">>>")
        leaf = {"Type": Name("Annot"), "Subtype": Name("Widget"), "FT": Name("Sig"), "T": f"Signature{top}", "Rect": [0, 0, 0, 0], "F": 132, "V": Ref(top + 1, 0)}
        fields = [*(f.get(form.get("Fields")) or []), Ref(top, 0)]
        return signed(append_revision(row["content"], {top: leaf, top + 1: value, f.trailer["Root"].num: {**f.root, "AcroForm": {**form, "Fields": fields, "SigFlags": 3}}}))

    return _map_documents(files, build, [c for c in files.columns if c != "content"])
