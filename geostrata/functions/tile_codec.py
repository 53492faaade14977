"""Tile content from the public 3D Tiles 1.0 and glTF 2.0 layouts: triangles with materials into B3DM and back.

Positions are float32 around the tile's center, z up turned to y up in the node's matrix.
"""

from __future__ import annotations

import json
import struct

import numpy as np

# Fixed values of the layouts.
B3DM_HEADER, GLB_JSON, GLB_BIN = 28, 0x4E4F534A, 0x004E4942
Y_UP = [1, 0, 0, 0, 0, 0, -1, 0, 0, 1, 0, 0, 0, 0, 0, 1]
DEFAULT_MATERIAL = {"rgba": [1.0, 1.0, 1.0, 1.0], "metallic": 0.0, "roughness": 1.0, "double_sided": True}


def _pad(data: bytes, to: int, fill: bytes) -> bytes:
    return data + fill * (-len(data) % to)


def normals(tri: np.ndarray) -> np.ndarray:
    """Unit normals by corner of (n, 3, 3) triangles; (0, 0, 1) where there is no area."""
    n = np.cross(tri[:, 1] - tri[:, 0], tri[:, 2] - tri[:, 0])
    size = np.linalg.norm(n, axis=1, keepdims=True)
    unit = np.where(size > 0, n / np.where(size > 0, size, 1), [0, 0, 1])
    return np.repeat(unit, 3, axis=0)


def encode_glb(primitives: list[dict], materials: list[dict]) -> bytes:
    """primitives: positions (n, 3), batch_ids (n,), material and, where there are any, normals, uvs, colors."""
    buffers: list[bytes] = []
    views, accessors, meshes = [], [], []

    def add(values: np.ndarray, kind: str, component: int, bounds: bool = False) -> int:
        data = values.tobytes()
        views.append({"buffer": 0, "byteOffset": sum(map(len, buffers)), "byteLength": len(data), "target": 34962})
        buffers.append(_pad(data, 4, b"\0"))
        a = {"bufferView": len(views) - 1, "byteOffset": 0, "componentType": component, "count": len(values), "type": kind}
        if bounds:
            a |= {"min": values.min(0).tolist(), "max": values.max(0).tolist()}
        accessors.append(a)
        return len(accessors) - 1

    for p in primitives:
        attributes = {"POSITION": add(np.ascontiguousarray(p["positions"], np.float32), "VEC3", 5126, True)}
        for name, key, kind in (("NORMAL", "normals", "VEC3"), ("TEXCOORD_0", "uvs", "VEC2"), ("COLOR_0", "colors", "VEC3")):
            if p.get(key) is not None:
                attributes[name] = add(np.ascontiguousarray(p[key], np.float32), kind, 5126)
        attributes["_BATCHID"] = add(np.ascontiguousarray(p["batch_ids"], np.float32), "SCALAR", 5126)
        meshes.append({"primitives": [{"attributes": attributes, "material": p["material"], "mode": 4}]})
    body = b"".join(buffers)
    head = {
        "asset": {"version": "2.0"}, "scene": 0, "scenes": [{"nodes": list(range(len(meshes)))}],
        "nodes": [{"matrix": Y_UP, "mesh": i} for i in range(len(meshes))], "meshes": meshes, "accessors": accessors, "bufferViews": views, "buffers": [{"byteLength": len(body)}],
        "materials": [{"pbrMetallicRoughness": {"baseColorFactor": list(m["rgba"]), "metallicFactor": m["metallic"], "roughnessFactor": m["roughness"]}, "doubleSided": bool(m["double_sided"]), "alphaMode": "BLEND" if m["rgba"][3] < 1 else "OPAQUE"} for m in materials],
    }
    images = list(dict.fromkeys(m["texture"] for m in materials if m.get("texture")))
    if images:
        head |= {"images": [{"uri": x} for x in images], "textures": [{"source": i, "sampler": 0} for i in range(len(images))], "samplers": [{"magFilter": 9729, "minFilter": 9987, "wrapS": 10497, "wrapT": 10497}]}
        for own, m in zip(head["materials"], materials, strict=True):
            if m.get("texture"):
                own["pbrMetallicRoughness"]["baseColorTexture"] = {"index": images.index(m["texture"])}
    text = _pad(json.dumps(head, separators=(",", ":")).encode(), 4, b" ")
    chunks = struct.pack("<II", len(text), GLB_JSON) + text + struct.pack("<II", len(body), GLB_BIN) + body
    return struct.pack("<4sII", b"glTF", 2, 12 + len(chunks)) + chunks


def hierarchy(instances: list[tuple]) -> dict:
    """The batch table's hierarchy of (id, parent id, class name, properties) in order: classes by first use, instances by position, parents that are instances, too."""
    place = {x[0]: i for i, x in enumerate(instances)}
    names = list(dict.fromkeys(x[2] for x in instances))
    classes = []
    for n in names:
        own = [x[3] for x in instances if x[2] == n]
        classes.append({"name": n, "length": len(own), "instances": {k: [p.get(k) for p in own] for k in dict.fromkeys(k for p in own for k in p)}})
    parents = [[place[x[1]]] if x[1] in place and x[1] != x[0] else [] for x in instances]
    return {"classes": classes, "instancesLength": len(instances), "classIds": [names.index(x[2]) for x in instances], "parentCounts": [len(p) for p in parents], "parentIds": [i for p in parents for i in p]}


def encode_b3dm(glb: bytes, batch_length: int, batch_table: dict) -> bytes:
    feature = json.dumps({"BATCH_LENGTH": batch_length}, separators=(",", ":")).encode()
    feature += b" " * (-(B3DM_HEADER + len(feature)) % 8)
    batch = _pad(json.dumps(batch_table, separators=(",", ":"), ensure_ascii=False).encode(), 8, b" ") if batch_table else b""
    glb = _pad(glb, 8, b"\0")
    return struct.pack("<4sIIIIII", b"b3dm", 1, B3DM_HEADER + len(feature) + len(batch) + len(glb), len(feature), 0, len(batch), 0) + feature + batch + glb


TYPES = {5126: np.float32, 5125: np.uint32, 5123: np.uint16, 5121: np.uint8}
WIDTH = {"SCALAR": 1, "VEC2": 2, "VEC3": 3, "VEC4": 4}


def decode_b3dm(data: bytes) -> tuple[int, dict, list[dict], list[dict]]:
    """(batch length, batch table, primitives as in encode_glb, materials); indexed primitives are written out."""
    magic, _, length, fj, fb, bj, bb = struct.unpack_from("<4sIIIIII", data)
    if magic != b"b3dm":
        raise ValueError("not a b3dm")
    at = B3DM_HEADER
    feature = json.loads(data[at : at + fj] or b"{}")
    at += fj + fb
    batch = json.loads(data[at : at + bj].strip() or b"{}")
    at += bj + bb
    glb = data[at:length]
    if glb[:4] != b"glTF":
        raise ValueError("no glTF inside")
    n = struct.unpack_from("<I", glb, 12)[0]
    head = json.loads(glb[20 : 20 + n])
    body = glb[20 + n + 8 :]

    def values(k: int) -> np.ndarray:
        a = head["accessors"][k]
        v = head["bufferViews"][a["bufferView"]]
        kind, width = TYPES[a["componentType"]], WIDTH[a["type"]]
        start, item = v.get("byteOffset", 0) + a.get("byteOffset", 0), np.dtype(kind).itemsize * width
        step = v.get("byteStride", item)
        raw = np.frombuffer(body, np.uint8, (a["count"] - 1) * step + item, start)
        rows = np.lib.stride_tricks.as_strided(raw, (a["count"], item), (step, 1)).copy()
        out = rows.view(kind)
        return out.reshape(-1) if width == 1 else out

    primitives = []
    for k, p in enumerate(x for m in head["meshes"] for x in m["primitives"]):
        own = {name: values(i) for name, i in p["attributes"].items()}
        if "indices" in p:
            index = values(p["indices"]).astype(np.int64)
            own = {name: v[index] for name, v in own.items()}
        count = len(own["POSITION"])
        primitives.append({"positions": own["POSITION"], "batch_ids": own.get("_BATCHID", np.full(count, k)).astype(np.int64), "material": p.get("material", 0), "normals": own.get("NORMAL"), "uvs": own.get("TEXCOORD_0"), "colors": own.get("COLOR_0")})
    materials = []
    for m in head.get("materials", []):
        pbr = m.get("pbrMetallicRoughness", {})
        texture = None
        if "baseColorTexture" in pbr:
            texture = head["images"][head["textures"][pbr["baseColorTexture"]["index"]]["source"]].get("uri")
        materials.append({"texture": texture, "rgba": list(pbr.get("baseColorFactor", [1.0, 1.0, 1.0, 1.0])), "metallic": pbr.get("metallicFactor", 1.0), "roughness": pbr.get("roughnessFactor", 1.0), "double_sided": m.get("doubleSided", False)})
    return feature.get("BATCH_LENGTH", 0), batch, primitives, materials or [DEFAULT_MATERIAL]


def _head(data: bytes) -> tuple[int, dict, bytes]:
    """(where the glTF starts, its JSON, its binary chunk with header) of a B3DM."""
    fj, fb, bj, bb = struct.unpack_from("<IIII", data, 12)
    at = B3DM_HEADER + fj + fb + bj + bb
    n = struct.unpack_from("<I", data, at + 12)[0]
    length = struct.unpack_from("<I", data, at + 8)[0]
    return at, json.loads(data[at + 20 : at + 20 + n]), data[at + 20 + n : at + length]


def pictures(data: bytes) -> list[str]:
    """The picture files that a B3DM names; none for other content."""
    return [x["uri"] for x in _head(data)[1].get("images", []) if x.get("uri") and not x["uri"].startswith("data:")] if data[:4] == b"b3dm" else []


def renamed(data: bytes, old: str, new: str) -> bytes:
    """The B3DM with a picture's name changed; nothing else of it is decoded."""
    at, head, rest = _head(data)
    for x in head.get("images", []):
        if x.get("uri") == old:
            x["uri"] = new
    text = _pad(json.dumps(head, separators=(",", ":")).encode(), 4, b" ")
    chunks = struct.pack("<II", len(text), GLB_JSON) + text + rest
    glb = _pad(struct.pack("<4sII", b"glTF", 2, 12 + len(chunks)) + chunks, 8, b"\0")
    return data[:8] + struct.pack("<I", at + len(glb)) + data[12:at] + glb
