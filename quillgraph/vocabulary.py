"""Vocabularies and constants that decide what is extracted, kept and shown. Operators take them as parameters."""

from __future__ import annotations

# Word lists, patterns and constants that results depend on.

WARS = [
    ("二战", ["二战", "第二次世界大战"]),
    ("一战", ["一战", "第一次世界大战"]),
    ("海湾战争", ["海湾战争", "沙漠风暴"]),
    ("朝鲜战争", ["朝鲜战争", "韩战"]),
    ("越南战争", ["越南战争", "越战"]),
    ("阿富汗战争", ["阿富汗战争"]),
    ("伊拉克战争", ["伊拉克战争"]),
    ("冷战", ["冷战"]),
    ("科索沃战争", ["科索沃战争"]),
    ("中东战争", ["中东战争", "中东地区的战争"]),
    ("印巴战争", ["印巴战争"]),
    ("苏芬战争", ["苏芬战争", "冬季战争"]),
    ("两伊战争", ["两伊战争"]),
    ("车臣战争", ["车臣战争"]),
    ("叙利亚内战", ["叙利亚内战"]),
    ("俄乌冲突", ["俄乌"]),
    ("马岛战争", ["福克兰战争", "马岛战争"]),
    ("太平洋战争", ["太平洋战争", "太平洋战役"]),
    ("诺曼底登陆", ["诺曼底"]),
    ("苏德战争", ["苏德战争", "卫国战争", "东线"]),
    ("第三次中东战争", ["六日战争"]),
    ("第四次中东战争", ["赎罪日战争"]),
    ("黎巴嫩战争", ["黎巴嫩战争"]),
    ("波黑战争", ["波黑战争"]),
    ("利比亚战争", ["利比亚战争"]),
    ("也门内战", ["也门"]),
    ("巴以冲突", ["巴以"]),
    ("克什米尔冲突", ["克什米尔"]),
    ("柬埔寨内战", ["柬埔寨"]),
    ("安哥拉内战", ["安哥拉"]),
    ("斯里兰卡内战", ["斯里兰卡内战"]),
    ("乌克兰冲突", ["乌克兰冲突", "顿巴斯"]),
    ("纳卡冲突", ["纳卡", "卡拉巴赫"]),
]

INSTITUTIONS = [
    ("克虏伯", ["克虏伯"]),
    ("莱茵金属", ["莱茵金属"]),
    ("凯迪拉克", ["凯迪拉克"]),
    ("BAE系统公司", ["BAE系统"]),
    ("韦斯特维尔特公司", ["韦斯特维尔特"]),
    ("乌拉尔运输机械设计局", ["乌拉尔运输机器设计局", "乌拉尔运输机械", "乌拉尔设计局"]),
    ("莫托维利哈工厂", ["莫托维利哈"]),
    ("格拉宾设计局", ["格拉宾"]),
    ("博福斯公司", ["博福斯"]),
    ("奥托梅莱拉", ["奥托梅莱拉"]),
    ("莱茵金属防空公司", ["莱茵金属防空"]),
    ("厄利孔公司", ["厄利孔"]),
    ("赫希施泰因工厂", ["赫希施泰因"]),
    ("尼斯特罗夫工厂", ["尼斯特罗夫"]),
    ("HMWF联合体", ["HMWF"]),
    ("洛克希德", ["洛克希德"]),
    ("通用动力", ["通用动力"]),
    ("雷神公司", ["雷神"]),
    ("波音公司", ["波音"]),
    ("马里兰兵工厂", ["马里兰兵工厂"]),
    ("岩岛兵工厂", ["岩岛兵工厂"]),
    ("沃特弗利特兵工厂", ["沃特弗利特"]),
    ("FMC公司", ["FMC"]),
    ("联合防务公司", ["联合防务"]),
    ("标致公司", ["标致"]),
    ("GIAT工业", ["GIAT"]),
    ("克劳斯-玛菲", ["克劳斯-玛菲", "克劳斯玛菲"]),
    ("瓦格纳兵工厂", ["瓦格纳"]),
    ("斯柯达", ["斯柯达"]),
    ("布尔公司", ["布尔公司"]),
    ("德拉伦", ["德拉伦"]),
    ("佩内明德", ["佩内明德"]),
    ("阿尔维斯", ["阿尔维斯"]),
    ("维克斯", ["维克斯"]),
    ("皇家兵工厂", ["皇家兵工厂"]),
    ("马可尼", ["马可尼"]),
    ("诺基亚", ["诺基亚"]),
    ("萨博", ["萨博"]),
    ("三菱重工", ["三菱重工"]),
    ("日本制钢所", ["日本制钢所"]),
    ("小松制作所", ["小松制作所"]),
    ("韩华防务", ["韩华"]),
    ("印度兵工厂", ["印度兵工厂", "兵工厂委员会"]),
    ("阿维布拉斯公司", ["阿维布拉斯"]),
    ("太空研究组织", ["太空研究组织"]),
    ("巴西宇航工业", ["巴西宇航"]),
    ("扎斯塔瓦", ["扎斯塔瓦"]),
    ("阿森纳", ["阿森纳"]),
]

CHASSIS = [
    ("M4谢尔曼底盘", ["M4谢尔曼", "谢尔曼坦克", "谢尔曼底盘", "M4中型坦克"]),
    ("M113底盘", ["M113底盘", "M113装甲车"]),
    ("M2布雷德利底盘", ["M2布雷德利", "M2步兵战车", "M2装甲车"]),
    ("T-34底盘", ["T-34底盘", "T-34坦克"]),
    ("T-80底盘", ["T-80坦克的底盘", "T-80底盘", "T-80坦克"]),
    ("四号坦克底盘", ["四号坦克底盘", "PzKpfw IV", "四号坦克"]),
    ("豹1底盘", ["豹1底盘", "豹1坦克"]),
    ("豹2底盘", ["豹2底盘", "豹2坦克"]),
    ("T-72底盘", ["T-72底盘", "T-72坦克"]),
    ("BMD底盘", ["BMD底盘", "BMD空降战车"]),
    ("BMP底盘", ["BMP底盘", "BMP步兵战车"]),
    ("MAZ卡车", ["MAZ卡车", "MAZ-543", "MAZ-7911"]),
    ("乌拉尔卡车", ["乌拉尔卡车"]),
    ("AMX-10底盘", ["AMX-10底盘"]),
    ("LAV-25底盘", ["LAV-25底盘"]),
    ("PT-76底盘", ["PT-76"]),
    ("SU-76底盘", ["SU-76"]),
    ("三号坦克底盘", ["三号坦克", "PzKpfw III"]),
    ("追猎者底盘", ["追猎者"]),
    ("FMTV卡车", ["FMTV"]),
    ("HEMTT卡车", ["HEMTT"]),
    ("M109底盘", ["M109底盘"]),
    ("2S1底盘", ["2S1"]),
    ("BTR底盘", ["BTR"]),
    ("猛士底盘", ["猛士"]),
    ("奔驰底盘", ["奔驰"]),
    ("普拉特底盘", ["普拉特"]),
    ("ZIL卡车", ["ZIL"]),
    ("GAZ卡车", ["GAZ"]),
    ("KrAZ卡车", ["KrAZ"]),
]

AMMUNITION = [
    ("高爆弹", ["高爆弹", "榴弹"]),
    ("火箭增程弹", ["火箭增程弹"]),
    ("子母弹", ["子母弹", "集束弹"]),
    ("照明弹", ["照明弹"]),
    ("烟幕弹", ["烟幕弹", "发烟弹"]),
    ("穿甲弹", ["穿甲弹"]),
    ("破甲弹", ["破甲弹", "HEAT"]),
    ("碎甲弹", ["碎甲弹", "HESH"]),
    ("制导炮弹", ["制导炮弹", "神剑", "Excalibur", "铜斑蛇", "Copperhead"]),
    ("炮射导弹", ["炮射导弹"]),
    ("核炮弹", ["核炮弹"]),
    ("化学弹", ["化学弹"]),
    ("燃烧弹", ["燃烧弹"]),
    ("白磷弹", ["白磷弹"]),
    ("混凝土破坏弹", ["混凝土破坏弹"]),
    ("半穿甲弹", ["半穿甲弹"]),
    ("杀伤弹", ["杀伤弹"]),
    ("宣传弹", ["宣传弹"]),
    ("训练弹", ["训练弹"]),
    ("曳光弹", ["曳光弹"]),
    ("脱壳穿甲弹", ["脱壳穿甲弹", "APFSDS", "尾翼稳定脱壳"]),
    ("钨芯弹", ["钨芯"]),
    ("贫铀弹", ["贫铀"]),
    ("反雷达弹", ["反雷达"]),
    ("激光制导炮弹", ["激光制导"]),
    ("卫星制导炮弹", ["卫星制导", "GPS制导"]),
]

DESIGNERS = [
    ("格拉宾", ["格拉宾"]),
    ("维克多·马克洛夫", ["维克多·马克洛夫"]),
    ("斐迪南·保时捷", ["保时捷博士", "斐迪南·保时捷"]),
    ("阿尔弗雷德·克虏伯", ["阿尔弗雷德·克虏伯"]),
]

SUBTYPES = [
    ("自行火炮", ["自行榴弹炮", "自行迫击炮", "自行火箭炮", "自行反坦克炮", "自行防空炮", "自行高射炮", "自走榴弹炮"]),
    ("牵引火炮", ["牵引榴弹炮", "牵引迫击炮", "牵引式"]),
    ("车载火炮", ["车载式", "车载型", "卡车炮"]),
    ("轻型火炮", ["轻型", "轻量化"]),
    ("重型火炮", ["重型"]),
    ("超重型火炮", ["超重型"]),
    ("空降火炮", ["空降", "空投"]),
    ("两栖火炮", ["两栖", "浮渡", "浮游能力"]),
    ("山地火炮", ["山地"]),
    ("多管火箭炮", ["多管"]),
    ("轮式自行火炮", ["轮式自行"]),
    ("高射炮", ["高射炮", "防空炮"]),
    ("舰炮", ["舰炮", "舰载"]),
]

BRANCHES = [
    ("陆军", ["陆军", "步兵师", "装甲师", "炮兵师", "炮兵旅", "炮兵团"]),
    ("海军", ["海军陆战队", "海军", "舰载"]),
    ("空军", ["空军", "空降师", "空中突击师"]),
    ("海军陆战队", ["海军陆战队"]),
]

NATIONS = [(n, [n]) for n in [
    "日本", "德国", "英国", "法国", "韩国", "印度", "巴西", "意大利", "瑞典", "瑞士",
    "波兰", "土耳其", "以色列", "埃及", "伊拉克", "伊朗", "沙特", "泰国", "澳大利亚", "加拿大",
    "荷兰", "比利时", "挪威", "丹麦", "西班牙", "葡萄牙", "希腊", "芬兰", "阿根廷", "智利",
    "巴基斯坦", "马来西亚", "印尼", "菲律宾", "南非", "尼日利亚", "摩洛哥", "约旦", "科威特", "阿联酋",
    "卡塔尔", "阿曼", "巴林", "台湾", "新加坡", "新西兰",
]]

VALID_WARS = ["一战", "二战", "海湾战争", "朝鲜战争", "越南战争", "阿富汗战争", "伊拉克战争", "冷战", "中东战争", "两伊战争", "太平洋战争", "苏德战争", "马岛战争", "诺曼底登陆", "纳卡冲突"]

CHAPTERS = [
    ("Chapter 02", ["榴弹炮"]),
    ("Chapter 03", ["迫击炮"]),
    ("Chapter 04", ["火箭炮"]),
    ("Chapter 05", ["反坦克炮"]),
    ("Chapter 06", ["防空火炮"]),
    ("Chapter 07", ["舰炮"]),
]

#: (prefix of a title, countries); the first that fits counts.
COUNTRY_PREFIXES = [
    ("英国/德国/意大利", ["英国", "德国", "意大利"]),
    ("捷克斯洛伐克", ["捷克斯洛伐克"]),
    ("俄罗斯", ["俄罗斯"]),
    ("苏联", ["苏联"]),
    ("德国", ["德国"]),
    ("美国", ["美国"]),
    ("英国", ["英国"]),
    ("法国", ["法国"]),
    ("瑞典", ["瑞典"]),
    ("日本", ["日本"]),
    ("韩国", ["韩国"]),
    ("波兰", ["波兰"]),
    ("巴西", ["巴西"]),
    ("印度", ["印度"]),
    ("瑞士", ["瑞士"]),
    ("意大利", ["意大利"]),
]

MODIFIERS = ["自行", "多管", "轮式", "遥控", "多口径", "型"]
SUFFIXES = ["榴弹炮", "迫击炮", "火箭炮", "反坦克炮", "高射炮", "防空炮", "防空系统", "舰炮", "加农炮", "榴弹发射器"]
QUOTES = "“”„‟"
UNIT = "毫米"

PARAMETERS = {
    "caliber": r"口径[：:\s]*(\d+)\s*毫米",
    "length": r"全长[：:\s]*([\d.]+)\s*米",
    "barrel_length": r"炮管长[：:\s]*([\d.]+)\s*米",
    "width": r"全宽[：:\s]*([\d.]+)\s*米",
    "height": r"全高[：:\s]*([\d.]+)\s*米",
    "weight": r"重量[：:\s]*([\d,]+)\s*千克",
    "rate_of_fire": r"(?:最大)?射速[：:\s]*([\d]+)\s*发[／/]分",
    "range": r"(?:有效)?射程[：:\s]*([\d,]+)\s*米",
}
PARAMETER_NAMES = {"caliber": "口径", "weight": "重量", "range": "射程", "rate_of_fire": "射速", "length": "全长", "barrel_length": "炮管长", "width": "全宽", "height": "全高"}

RELATIONS = {"DEVELOPED_IN": "研发国家", "IS_TYPE_OF": "类型", "DESIGNED_BY": "设计方", "USES_AMMO": "弹药", "DERIVED_FROM": "衍生型号", "PARTICIPATED_IN": "参战", "USES_CHASSIS": "底盘", "EQUIPPED_BY": "装备国家"}
LABELS = ["Artillery", "Country", "Category", "Institution", "Designer", "Ammunition", "Derivative", "War", "Chassis"]
#: Order in which the neighbours of a node are taken in.
PRIORITY = ["DEVELOPED_IN", "IS_TYPE_OF", "DESIGNED_BY", "USES_CHASSIS", "USES_AMMO", "PARTICIPATED_IN", "EQUIPPED_BY", "DERIVED_FROM"]

SECTION = "衍生型号"
SECTION_ENDS = ["服役记录", "10秒速识", "性能解析", "武器构造", "全球火炮鉴赏指南"]
SERVICE_SECTION = "服役记录"
TABLE_HEADS = ("型号", "特点")
TABLE_NOISE = ["全球火炮", "Chapter", "第", "版"]
NOT_DESCRIPTIONS = ["全球火炮", "Chapter", "第"]

#: Words that no derivative's name has: in the cleaned graph, and in the shown one.
NOT_DERIVATIVES_CLEAN = ["换装", "安装", "整合", "由", "最初称", "炮塔", "瞄准具", "衍生型", "火炮"]
NOT_DERIVATIVES_SHOWN = ["换装", "安装", "整合", "由", "最初称", "炮塔", "瞄准具", "火炮", "系统衍生型"]
CHASSIS_WORDS, NOT_CHASSIS = ["底盘", "卡车"], ["谢尔曼坦克", "坦克", "步兵战车", "装甲车"]

#: Metric, its name, its unit, the largest value of its scale.
METRICS = [("caliber", "口径", "mm", 240.0), ("range", "射程", "m", 45000.0), ("weight", "重量", "kg", 50000.0), ("rate_of_fire", "射速", "发/分", 30.0), ("length", "全长", "m", 15.0), ("height", "全高", "m", 5.0)]
STOP_WORDS = ["什么", "哪些", "哪个", "如何", "介绍", "一下", "这个", "火炮", "武器", "装备", "性能", "特点", "关系", "知识", "图谱"]
#: Attributes that a context block or a node card shows.
FACTS = [("category", "类别"), ("caliber", "口径"), ("range", "射程"), ("weight", "重量"), ("rate_of_fire", "射速")]
BLOCK, BLOCK_FACTS, BLOCK_RELATIONS, BLOCK_TEXT, NOTHING = "【火炮】", "基础属性：", "图谱关系：", "原书OCR摘录：", "无"
UNKNOWN = "未知"

RING_ORDER = ["Country", "Category", "Institution", "Designer", "Chassis", "Ammunition", "War", "Derivative", "Artillery"]
RING_RADII = {"Artillery": 6.2, "Derivative": 8.2, "Country": 1.2, "Category": 2.1, "Institution": 3.0, "Designer": 3.6, "Chassis": 4.2, "Ammunition": 5.0, "War": 5.7}

#: What counts how much in retrieval: candidates at most, a name, a model, a long and a short token, an edge's target, a
#: neighbour, a mention, and the least that is relevant.
TOP, NAME, MODEL, LONG, SHORT, EDGE, NEIGHBOUR, MENTION, LEAST = 4, 12, 8, 2, 1, 5, 3, 2, 3

#: Sentences of answers.
ASK = "请输入问题。"
BOTH, NOT_BOTH = "{war}中由{maker}设计或生产关联的火炮有: {names}", "当前清洗后的图谱中未检索到同时满足“{war}”和“{maker}”条件的火炮。"
LARGEST, NO_LARGEST = "基于{ride}的火炮中，口径最大的是 {name}，口径约为 {value:g} 毫米。", "当前清洗后的图谱中未检索到与 {ride} 相连且带口径属性的火炮。"
OF_WAR, NOT_OF_WAR = "{war}关联火炮包括: {names}", "当前图谱中没有检索到 {war} 的关联火炮。"
OF_COUNTRY, NOT_OF_COUNTRY = "{country}研制的火炮示例: {names}", "当前图谱中没有检索到 {country} 研制火炮。"
LOCAL, OUT, IN = "{name} 的局部知识如下。{edges}", "出边", "入边"
UNSUPPORTED = "暂不支持该问法。可尝试：`二战中使用了哪些克虏伯设计的火炮`、`基于M4谢尔曼底盘改造的火炮，口径最大的是多少`。"
IRRELEVANT = "这个问题与当前知识库没有明显关联，我只能回答已构建火炮知识图谱范围内的问题。"
ONLY_FOUND = "已找到相关知识库内容，但没有可用的语言模型，因此只能给出检索摘要：\n"

#: A word of a question: Latin letters and digits, or two and more Chinese characters.
TOKEN = r"[A-Za-z0-9][A-Za-z0-9\-]*|[一-龥]{2,}"
#: A number, as a measured value gives it.
NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
