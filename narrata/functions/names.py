"""Names of people: keys, roles, which names may be shown, which is the fuller one."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from narrata.operators.text import stripped

#: Names that say a role and not who (fixed values).
GENERIC = "男生 女生 同学 男同学 女同学 老师 男客 轻浮男客 店员".split()
ROLES = [*GENERIC, *"店长 副店长 女神 水之女神 女骑士 男骑士 骑士 十字骑士 圣骑士 无头骑士 魔王军干部 冒险者 少女 少年 美少女 大祭司 师傅 大师".split()]
#: Titles after a name, roles before one, looks before a role, and what can't be in a shown name (fixed values).
TITLED = "(?:同学|老师|先生|小姐|大人|前辈|哥哥|姐姐|师傅)$"
INTRODUCED = "^(?:书店的|书店)?(?:女店员|男店员|店员|老师|同学)$"
LOOKS = "^(?:自称|高个子|矮个子|金发|银发|黑发|红发)?(?:女神|女生|男生|少女|少年|美少女|女骑士|男骑士|无头骑士)$"
NOT_SHOWN = r"[（）(),，。；;\n]|本章|第一人称|叙述者|向.+搭讪|的打工前辈"
PLACEHOLDER = r"(?i)^(?:S\d+|new\d+|未知人物|未知|不确定)$"
LONGEST = 32


def key(name: Column) -> Column:
    """The stripped name without case; empty for null."""
    return F.lower(stripped(F.coalesce(name, F.lit(""))))


def undecorated(name: Column) -> Column:
    """The name without what follows in brackets."""
    return stripped(F.regexp_replace(stripped(F.coalesce(name, F.lit(""))), r"(?s)[（(].*$", ""))


def is_role(name: Column) -> Column:
    plain = undecorated(name)
    return plain.isin(ROLES) | plain.rlike(LOOKS)


def can_be_shown(name: Column) -> Column:
    plain = stripped(F.coalesce(name, F.lit("")))
    return F.length(plain).between(1, LONGEST) & ~plain.rlike(NOT_SHOWN) & ~plain.rlike(PLACEHOLDER)


def fuller(current: Column, proposed: Column) -> Column:
    """proposed, where it may be shown, is no role or title, and current is empty, a role or a part at its start or end."""
    old, new = stripped(F.coalesce(current, F.lit(""))), stripped(F.coalesce(proposed, F.lit("")))
    usable = can_be_shown(new) & ~is_role(new) & ~new.rlike(TITLED)
    part = (F.length(old) >= 2) & (F.length(new) > F.length(old)) & (F.startswith(new, old) | F.endswith(new, old))
    return F.when(usable & ((old == "") | is_role(old) | part), new).otherwise(old)


def matches(value: Column, name: Column) -> Column:
    """Whether value, undecorated, is the name, or the name after a role."""
    plain = undecorated(value)
    prefix = F.substring(plain, F.lit(1), F.greatest(F.length(plain) - F.length(name), F.lit(0)))
    return (key(name) != "") & ((key(plain) == key(name)) | (F.endswith(plain, name) & prefix.rlike(INTRODUCED)))
