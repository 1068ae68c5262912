"""Names that the schema derives from declarations."""

from __future__ import annotations

import keyword
import re


def plural_field(entity: str) -> str:
    return entity + "s"


def camel(name: str) -> str:
    """``hair_color`` -> ``hairColor``."""
    head, *rest = name.split("_")
    return head + "".join(x[:1].upper() + x[1:] for x in rest)


def entity_name(table: str) -> str:
    """``home_worlds`` -> ``HomeWorld``."""
    out = "".join(x[:1].upper() + x[1:] for x in table.split("_") if x)
    return out[:-1] if out.endswith("s") and len(out) > 1 else out


def variant(name: str) -> str:
    """``NewHope`` -> ``NEW_HOPE``."""
    return re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "_", name).upper()


def key_type(table: str) -> str:
    """The input type of a table's primary key."""
    flat = table.replace(".", "_")
    return flat[:1].upper() + flat[1:] + "PrimaryKey"


def safe(name: str) -> str:
    """A column's name as an attribute: reserved words get an underscore."""
    return name + "_" if keyword.iskeyword(name) or keyword.issoftkeyword(name) else name


def filter_value_name(type_name: str, nullable: bool) -> str:
    """The name a value type goes by in filter types: ``Vec_Double_``, ``Nullable_Int_``."""
    base = {"Boolean": "bool"}.get(type_name, type_name)
    if base.startswith("["):
        base = f"Vec_{base[1:-1]}_"
    return f"Nullable_{base}_" if nullable else base
