"""Readings of names: kana to Latin letters, and readings of the characters that names are written with."""

from __future__ import annotations

import unicodedata
from functools import lru_cache
from itertools import product

# The syllables of kana in Hepburn's spelling, in the order of the kana table.
_ROWS = {
    "": "あいうえお", "k": "かきくけこ", "s": "さしすせそ", "t": "たちつてと", "n": "なにぬねの", "h": "はひふへほ", "m": "まみむめも", "y": "や ゆ よ", "r": "らりるれろ", "w": "わゐ ゑを",
    "g": "がぎぐげご", "z": "ざじずぜぞ", "d": "だぢづでど", "b": "ばびぶべぼ", "p": "ぱぴぷぺぽ", "v": "  ゔ  ",
}
_IRREGULAR = {"し": "shi", "ち": "chi", "つ": "tsu", "ふ": "fu", "じ": "ji", "ぢ": "ji", "づ": "zu", "ゐ": "i", "ゑ": "e", "を": "o", "ん": "n"}
_SMALL = {"ゃ": "a", "ゅ": "u", "ょ": "o"}
_VOWELS = {"ぁ": "a", "ぃ": "i", "ぅ": "u", "ぇ": "e", "ぉ": "o"}

# Common readings of characters in Japanese names of people and firms (Hepburn), in the order of the Chinese radicals' sense groups.
CHARACTERS = {
    "一": "ichi", "三": "mi", "千": "chi", "八": "ya", "上": "ue kami", "中": "naka", "下": "shita", "久": "ku hisa", "之": "no", "也": "ya", "人": "to hito", "介": "suke", "代": "yo shiro", "伊": "i", "依": "i", "倫": "rin", "健": "ken", "健吾": "kengo",
    "出": "shutsu", "出版": "shuppan", "分": "bun", "刷": "satsu", "北": "kita", "南": "minami", "東": "higashi to", "西": "nishi", "印": "in", "原": "hara bara", "口": "kuchi guchi", "台": "dai", "吾": "go", "呂": "ro", "坂": "saka zaka", "垣": "kaki gaki",
    "塚": "tsuka zuka", "夜": "ya", "太": "ta", "太郎": "taro", "子": "ko shi", "宮": "miya", "小": "ko o", "屋": "ya", "居": "i", "山": "yama", "岡": "oka", "岸": "kishi", "島": "shima jima", "嶺": "mine", "川": "kawa gawa", "巻": "maki", "希": "ki", "平": "hira",
    "弥": "ya", "弥生": "yayoi", "所": "sho", "拓": "taku", "拓海": "takumi", "斎": "sai", "斎藤": "saito", "斉": "sai", "新": "shin", "日": "hi", "星": "hoshi", "明": "aki", "暁": "aki", "月": "tsuki zuki", "月見里": "yamanashi", "望": "nozomi", "木": "ki", "本": "moto", "朝": "asa",
    "村": "mura", "杉": "sugi", "松": "matsu", "林": "hayashi", "柚": "yuzu", "査": "sa", "桐": "kiri", "桜": "sakura zakura", "梢": "kozue", "森": "mori", "椿": "tsubaki tsuba", "椿本": "tsubamoto", "楠": "kusu", "槙": "maki", "樫": "kashi", "橋": "hashi bashi", "正": "masa",
    "比": "hi", "水": "mizu", "汐": "shio", "江": "e", "池": "ike", "沖": "oki", "沢": "sawa zawa", "沼": "numa", "浜": "hama", "浩": "hiro ko", "浩志": "hiroshi", "海": "umi", "深": "fuka", "清": "kiyo", "渚": "nagisa", "測": "soku", "渡": "watari wata", "渡辺": "watanabe",
    "澄": "sumi", "澄江": "sumie", "灯": "to", "版": "pan", "環": "tamaki", "生": "yu o", "田": "ta da", "留": "tome", "目": "me", "石": "ishi", "真": "ma", "真帆": "maho", "瀬": "se", "瀬良": "sera", "磨": "ma", "秋": "aki shu", "稲": "ina", "立": "tate", "笹": "sasa",
    "紗": "sa", "紗月": "satsuki", "置": "oki", "羽": "ha", "良": "ra", "花": "hana", "芙": "fu", "芙美": "fumi", "苑": "on", "苔": "koke", "荻": "ogi", "萩": "hagi", "萩之台": "haginodai", "葉": "ha", "葛": "kuzu", "蒼": "so", "蒼一": "soichi", "蓮": "hasu", "藤": "fuji",
    "製": "sei", "見": "mi", "計": "kei", "設": "sek", "設計": "sekkei", "諒": "ryo", "亮": "ryo", "涼": "ryo", "谷": "ya tani", "调": "cho", "調": "cho", "路": "ji", "輸": "yu", "辺": "be nabe", "辻": "tsuji", "遠": "to", "遼": "ryo", "運": "un", "郁": "iku", "郎": "ro", "里": "sato",
    "野": "no", "鈴": "suzu", "鈴木": "suzuki", "長": "naga", "雪": "yuki", "雲": "kumo", "電": "den", "霜": "shimo", "霧": "kiri", "青": "ao", "音": "on", "響": "kyo", "風": "kaze bu", "香": "kao", "高": "taka", "鳥": "tori", "鳴": "nari", "鴇": "toki", "鷺": "sagi", "鹿": "roku shika", "麦": "baku mugi",
    "賢": "ken", "史": "shi", "匠": "taku", "純": "sumi", "麻": "ma", "育": "iku", "次": "tsugu ji", "治": "ji haru", "裕": "hiro", "俊": "toshi", "和": "kazu", "佳": "yoshi", "乃": "no", "奏": "kanade", "透": "toru", "栞": "shiori", "耕": "ko", "亘": "wataru",
    "帆": "ho", "志": "shi", "嗣": "tsugu", "歳": "tose", "織": "ori", "美": "mi", "崎": "saki zaki", "尾": "o", "作": "saku", "段": "dan", "会": "kai", "社": "sha", "比良": "hira", "ノ": "no", "ケ": "ga ke",
}
# Forms of one and the same character.
VARIANTS = str.maketrans({"髙": "高", "﨑": "崎", "澤": "沢", "邊": "辺", "邉": "辺", "ヶ": "ケ", "が": "が", "齋": "斎", "齊": "斎", "斉": "斎", "濱": "浜", "嶋": "島", "櫻": "桜", "槇": "槙", "眞": "真", "國": "国", "廣": "広", "瀨": "瀬"})
# Loan words in names of firms.
LOANS = {"フーズ": "foods", "クリーン": "clean", "ロジ": "logi", "システム": "system", "サービス": "service", "テック": "tech"}


def _syllables() -> dict[str, str]:
    table = {}
    for consonant, row in _ROWS.items():
        for kana, vowel in zip(row, "aiueo"):
            if kana != " ":
                table[kana] = _IRREGULAR.get(kana, consonant + vowel)
    for kana, base in list(table.items()):
        if base.endswith("i") and len(base) > 1:
            for small, vowel in _SMALL.items():
                stem = base[:-1]
                table[kana + small] = stem + vowel if stem in ("sh", "ch", "j") else stem + "y" + vowel
    return table | _VOWELS | {"ん": "n", "ゃ": "ya", "ゅ": "yu", "ょ": "yo"}


SYLLABLES = _syllables()
_SOUNDS = frozenset(SYLLABLES.values())
_CODES = {sound: chr(0xE000 + n) for n, sound in enumerate(sorted(_SOUNDS))}


def sound_key(parts: list[str]) -> str:
    """Syllables as a string of one character each, so that errors of whole kana are single errors."""
    return "".join(_CODES.get(p, p) for p in parts)


def hiragana(text: str) -> str:
    """Katakana as hiragana."""
    return "".join(chr(ord(c) - 0x60) if "ァ" <= c <= "ヶ" else c for c in text)


def romaji(kana: str) -> str:
    """Latin letters of kana; other characters stay."""
    text, out, i = hiragana(unicodedata.normalize("NFKC", kana)), [], 0
    while i < len(text):
        two = SYLLABLES.get(text[i : i + 2]) if i + 1 < len(text) else None
        if two is not None:
            out.append(two)
            i += 2
        elif text[i] == "っ" and i + 1 < len(text):
            nxt = SYLLABLES.get(text[i + 1 : i + 3], SYLLABLES.get(text[i + 1], ""))
            out.append("t" if nxt.startswith("ch") else nxt[:1])
            i += 1
        elif text[i] == "ー":
            i += 1
        else:
            out.append(SYLLABLES.get(text[i], text[i]))
            i += 1
    return "".join(out)


def short(latin: str) -> str:
    """Long vowels written once, as passports do."""
    for long, one in (("ou", "o"), ("oo", "o"), ("uu", "u"), ("ō", "o"), ("ū", "u")):
        latin = latin.replace(long, one)
    return latin


def syllables(latin: str) -> list[str]:
    """Latin letters of kana as syllables; any other letter stands alone."""
    out, i, longest = [], 0, 3
    while i < len(latin):
        part = next((latin[i : i + n] for n in range(longest, 0, -1) if latin[i : i + n] in _SOUNDS), latin[i])
        out.append(part)
        i += len(part)
    return out


def folded(text: str) -> str:
    """Compatibility forms, variants of characters and kinds of no and ga made one."""
    text = unicodedata.normalize("NFKC", text).translate(VARIANTS)
    return "".join(c for c in text if not 0xFE00 <= ord(c) < 0xFE10 and unicodedata.category(c) != "Cf")


@lru_cache(maxsize=1 << 16)
def readings(text: str) -> frozenset[str]:
    """Every reading of a stretch of characters and kana that the table allows; empty if one is unknown."""
    known: list[set[str]] = [set() for _ in range(len(text) + 1)]
    known[0] = {""}
    for i in range(len(text)):
        if not known[i]:
            continue
        for j in range(i + 1, min(len(text), i + 5) + 1):
            part = text[i:j]
            found = [LOANS[part]] if part in LOANS else CHARACTERS.get(part, "").split()
            if j == i + 1 and not found and (SYLLABLES.get(hiragana(part)) or part == "ー"):
                end = j
                while end < len(text) and hiragana(text[end]) in (*SYLLABLES, "ー", "っ"):
                    end += 1
                for stop in range(j, end + 1):
                    known[stop] |= {a + romaji(text[i:stop]) for a in known[i]}
            elif j == i + 1 and hiragana(part) in SYLLABLES:
                found = [*found, romaji(part)]
            known[j] |= {a + b for a, b in product(known[i], found)}
    return frozenset(short(r) for r in known[len(text)])
