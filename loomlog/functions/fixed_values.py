"""Words, patterns, labels and layouts that decide the results.

Everything below is data that has to be exactly so for the numbers to come out right. Patterns are
written for Java's regex engine; the leading ``(?d)`` makes ``.`` and ``$`` treat only ``\\n`` as a
line end, and white space is spelled out because Java's ``\\s`` is ASCII only.
"""

# --- white space -------------------------------------------------------------------------------
SPACE_CHARS = (
    "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
SPACE = r"[\s\x85\p{Z}]"
NOT_SPACE = r"[^\s\x85\p{Z}]"

# --- line patterns: who did what ---------------------------------------------------------------
NORMAL_ATTACK = r"(?d)^(?<actor>.+?)の攻撃"
CAST_START_WITH_TARGET = r"(?d)^(?<actor>.+?)は、.+?に(?<action>.+?)を唱えた。?$"
CAST_START = r"(?d)^(?<actor>.+?)は、(?<action>.+?)を唱えた。?$"
ACTIVATION = r"(?d)^(?<actor>.+?)の(?<action>.+?)が発動。?$"
CAST_OR_USE_ACTOR = r"(?d)^(?<actor>.+?)は、.+?(?:を実行|を唱えた)"
ACTIVATED_ACTOR = r"(?d)^(?<actor>.+?)の.+?が発動"
SKILL = r"(?d)^.+?は、(?<action>.+?)を実行"
ABILITY_ROLL = (
    r"(?d)^(?<actor>[A-Za-z][A-Za-z0-9 '._-]*)の(?<action>[^→、。！!\r\n]+ロール)→合計値が(?<total>[0-9]+)になった[！!]$"
)
ABILITY_DOUBLE_UP = r"(?d)^(?<actor>[A-Za-z][A-Za-z0-9 '._-]*)の(?<action>ダブルアップ)$"
ABILITY_DECLARATION = r"(?d)^(?<actor>[A-Za-z][A-Za-z0-9 '._-]*)の(?<action>[^、。！!\r\n]+)[！!]$"
DOUBLE_UP_RESULT = r"(?d)^→[^→、。！!\r\n]+ロールの合計値が(?<total>[0-9]+)になった[！!]$"

# --- line patterns: what came of it ------------------------------------------------------------
DAMAGE_VALUE = r"(?:に、|は、)?(?<damage>[0-9]+)(?:ダメージ|HP吸収)"
EFFECT_GAINED = r"(?d)^→?.+?は、.+?の効果。?$"
STATUS_GAINED = r"(?d)^→?.+?は、.+?の状態になった！?$"
RESOURCE_ABSORBED = r"(?d)(?:^|→).+?から、[0-9]+(?:MP|TP)吸収。?$"
HP_RECOVERED = r"(?d)(?:^|→).+?のHPが、[0-9]+回復[！。]?$"
STATUS_REMOVED = r"(?d)(?:^|→).+?の.+?の効果を消し去った！?$"

INCOMING_DAMAGE = (
    r"(?d)(?:^|。|→)" + SPACE + r"*→?(?<target>[^→、。]+?)(?:に、|は、)(?<damage>[0-9]+)(?:ダメージ|HP吸収)[。！!]?$"
)
INCOMING_EVADE = (
    r"(?d)(?:^|。|→)" + SPACE + r"*(?:ミス[！!]" + SPACE
    + r"*)?→?(?<target>[^→、。！!]+?)は、?(?:攻撃を)?(?:回避した|かわした)[。！!]?$"
)
INCOMING_MISS = r"(?d)(?:^|。|→)" + SPACE + r"*→?(?<target>[^→、。]+?)に、ミス[。！!]?$"

TIMELINE_DAMAGE = (
    r"(?d)^" + SPACE + r"*→?(?<target>[^→、]+?)(?:に、|は、)(?<damage>[0-9]+)(?:ダメージ|HP吸収)[。！!]?$"
)
TIMELINE_RECOVERY = r"(?d)^" + SPACE + r"*→?(?<target>[^→、]+?)のHPが、(?<amount>[0-9]+)回復[。！!]?$"
TIMELINE_ABSORB = r"(?d)^" + SPACE + r"*→?(?<target>[^→、]+?)から、(?<amount>[0-9]+)(?<resource>TP|MP)吸収[。！!]?$"

# --- line patterns: everything else ------------------------------------------------------------
POINT_GAIN = (
    r"(?d)^→?.+?は、(?:(?<chain>[0-9]+)チェーン[！!])?(?<points>[0-9]+)"
    r"(?<point>経験値|リミットポイント|エクゼンプラーポイント)を獲得した。?$"
)
GALLIMAUFRY_GAIN = r"(?d)^→?.+?は、ガリモーフリーを(?<points>[0-9]+)得た、[0-9]+になった。?$"
AREA_CHANGE = r"(?d)^===" + SPACE + r"*(?<area>.+?)" + SPACE + r"*===$"
TIME_ANYWHERE = r"\[(?<time>(?<hour>[0-9]{1,2}):(?<minute>[0-9]{2})(?::(?<second>[0-9]{2}))?)\]"
TIME_BRACKETED = r"^\[(?<hour>[0-9]{2}):(?<minute>[0-9]{2})(?::(?<second>[0-9]{2}))?\]$"
TIME_BARE = r"^\[?(?<hour>[0-9]{1,2}):(?<minute>[0-9]{2})(?::(?<second>[0-9]{2}))?\]?$"
MARKER_KEYWORD = r"(?<keyword>[A-Za-z0-9_\-:.]+|" + NOT_SPACE + r"+)"
PC_NAME = r"(?d)^[A-Za-z]{1,15}$"
SNAPSHOT_NAME = r"^(?<window>[12])_(?<rotation>[0-9]|1[0-9])\.log$"

# --- words -------------------------------------------------------------------------------------
NORMAL_ATTACK_NAME = "通常攻撃"
CRITICAL_WORDS = ("クリティカル",)
EXCLUDED_WORDS = ("詠唱中断", "発動失敗", "使用失敗")
MISS_WORDS = ("ミス", "回避", "かわした", "効果なし", "効果がなかった", "レジストされた", "魔法効果をレジストした")
CHAIN_WORD = "連携"
INTERRUPT_PHRASES = ("詠唱中断", "詠唱を中断")
INTERRUPT_ANCHOR_WORD = "中断"
FAILURE_WORDS = ("使用失敗", "発動失敗")
JOB_POINT_NOTICE = "ジョブポイントがアップ"
DOUBLE_UP_NAME = "ダブルアップ"
MARKER_PREFIX = "###"
POINT_NAMES = ("経験値", "リミットポイント", "エクゼンプラーポイント", "ガリモーフリー")
GALLIMAUFRY = "ガリモーフリー"

# --- codes, in their sorting order -------------------------------------------------------------
ACTION_TYPES = ("normal_attack", "normal_attack_critical", "weapon_skill", "magic", "unknown", "ability")
HIT_STATUSES = ("hit", "miss", "excluded", "unknown")
TIME_CONFIDENCES = ("exact", "minute", "estimated", "unknown")
PHYSICAL_TYPES = ("normal_attack", "normal_attack_critical", "weapon_skill", "ability")
SESSION_STATUSES = ("unknown", "active", "completed", "aborted")
ACTOR_KINDS = ("registered_npc", "registered_pc", "pc_candidate", "unknown")
RESOURCE_KINDS = ("hp_recovery", "tp_absorb", "mp_absorb")

# --- labels ------------------------------------------------------------------------------------
EVENT_STATUS_LABELS = {
    "interrupted": "中断",
    "failed": "失敗",
    "damage_confirmed": "ダメージ確認",
    "effect_confirmed": "効果確認",
    "missed": "ミス・効果なし",
    "unconfirmed": "実行・結果未確認",
}
CONFIDENCE_LABELS = {"exact": "秒単位", "minute": "分単位", "estimated": "推定", "unknown": "不明"}
ACTION_TYPE_LABELS = {
    "normal_attack": "通常攻撃",
    "normal_attack_critical": "通常攻撃（クリティカル）",
    "weapon_skill": "WS",
    "ability": "アビリティ",
    "magic": "魔法",
    "unknown": "未分類",
}
SESSION_STATUS_LABELS = {"active": "収集中", "completed": "完了", "aborted": "中断", "unknown": "不明"}
UNPARSED_REASON = "actorまたはactionを特定できません。"
UNKNOWN_TIME_WARNING = "分析開始時刻または終了時刻を確定できません。"
EMPTY_TIME_WARNING = "分析時間が0秒以下のためDPSを算出できません。"

# --- binary snapshot layout --------------------------------------------------------------------
HEADER_BYTES = 100
HEADER_OFFSETS = 50
META_FIELDS = 21
META_COLOR, META_GROUP, META_SEQUENCE, META_TOKENS, META_UNIX_TIME = 3, 4, 5, 6, 19
CONTROL_PREFIXES = (0x1E, 0x1F, 0x7F, 0xEF)
TEXT_ENCODING = "cp932"
MAX_SLOTS = 20

# --- CSV layouts: (column, heading) ------------------------------------------------------------
CSV_LAYOUTS = {
    "actors": (
        ("actor", "キャラクター名"),
        ("total_damage", "総与ダメージ"),
        ("dps", "DPS"),
        ("time_confidence", "DPS時間信頼度"),
        ("normal_attack_hit_rate", "通常攻撃命中率"),
        ("normal_attack_critical_rate", "通常攻撃クリティカル率"),
        ("use_count", "使用回数"),
        ("hit_count", "命中回数"),
        ("miss_count", "非命中回数"),
        ("unknown_count", "未分類件数"),
    ),
    "actions": (
        ("actor", "キャラクター名"),
        ("action_name", "アクション名"),
        ("action_type", "種別"),
        ("use_count", "使用回数"),
        ("hit_count", "命中回数"),
        ("miss_count", "非命中回数"),
        ("unknown_count", "未分類件数"),
        ("hit_rate", "命中率"),
        ("total_damage", "総ダメージ"),
        ("max_damage", "最大ダメージ"),
        ("min_damage", "最小ダメージ"),
        ("average_damage", "平均ダメージ"),
    ),
    "points": (
        ("point_name", "ポイント種別"),
        ("total_points", "総合計"),
        ("max_chain", "最大チェーン"),
        ("points_per_hour", "時給"),
    ),
}
