"""Explicit schemas of the stages. JSON files keyed by names must be read as maps, never by inference."""

TOC = "seq bigint, level int, title string, page int"
ENTITY = "seq bigint, name string, model string, core_model string, caliber string, category string, subtype string, page int, countries array<string>"
EDGE = "seq bigint, source string, source_type string, relation string, target string, target_type string, method string, description string"
EDGE_FIELDS = "source string, source_type string, relation string, target string, target_type string, method string, description string"
ENTITY_FIELDS = "name string, model string, core_model string, caliber string, category string, subtype string, page int, countries array<string>, parameters map<string,string>"
IMAGE_META = "map<string,struct<page:int,method:string,size:array<int>,page_size:array<double>,bbox:array<double>>>"


def _struct(fields: str) -> str:
    return "struct<" + ", ".join(f.strip().replace(" ", ": ", 1) for f in _split(fields)) + ">"


def _split(fields: str) -> list[str]:
    out, depth = [""], 0
    for c in fields:
        depth += {"<": 1, ">": -1}.get(c, 0)
        if c == "," and not depth:
            out.append("")
        else:
            out[-1] += c
    return out


OUTLINE_FILE = f"artillery array<{_struct(ENTITY_FIELDS)}>, countries array<string>, categories array<string>, relations array<{_struct(EDGE_FIELDS)}>"
EXTRACT_FILE = f"{OUTLINE_FILE}, image_map map<string,string>, image_meta {IMAGE_META}, weapon_texts map<string,string>, image_binding array<struct<name: string, page: int, image_path: string, image_method: string>>"
GRAPH_FILE = f"entities map<string,array<string>>, relations array<{_struct(EDGE_FIELDS)}>"
PAGE_FILE = "map<string,string>"
