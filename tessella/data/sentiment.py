"""Default sentiment tables. Callers pass their own lexicon in the same form."""

# Our own lexicon, (word, weight); Chinese and English share one table.
POSITIVE = [(w, v) for v, words in {
    0.95: "完美 perfect outstanding superb",
    0.9: "优秀 喜欢 满意 幸福 excellent amazing wonderful fantastic brilliant love",
    0.85: "高兴 成功 精彩 great awesome delight impressive",
    0.8: "推荐 感动 惊喜 happy beautiful recommend enjoy grateful",
    0.75: "好 方便 专业 舒适 good nice helpful friendly comfortable reliable",
    0.7: "实用 划算 useful clean easy fresh honest neat heart shine",
    0.6: "可以 稳定 fine decent fair calm steady heed",
}.items() for w in words.split()]
NEGATIVE = [(w, v) for v, words in {
    -0.95: "垃圾 恶心 disgusting horrible worst",
    -0.9: "糟糕 失望 terrible awful hate useless",
    -0.85: "愤怒 欺骗 scam broken fraud threat",
    -0.8: "讨厌 难受 angry annoying disappoint painful",
    -0.75: "差 坏 bad poor dirty rude ugly",
    -0.7: "麻烦 浪费 waste slow noisy boring sting",
    -0.6: "一般 犹豫 dull weak tired worry",
}.items() for w in words.split()]
LEXICON = POSITIVE + NEGATIVE

EMOJI = [(e, v) for v, signs in {
    0.9: "😀 😁 😍 🥰 🎉", 0.8: "😊 👍 💪 🌟", 0.6: "🙂 😌",
    -0.6: "😕 😐", -0.8: "😞 😢 👎 💔", -0.9: "😡 😠 🤮 😭",
}.items() for e in signs.split()]

# Degree words and their factors.
INTENSIFIERS = [
    ("非常", 1.8), ("极其", 2.0), ("极度", 2.0), ("万分", 1.9), ("分外", 1.6),
    ("格外", 1.6), ("特别", 1.7), ("尤其", 1.7), ("十分", 1.6), ("相当", 1.5),
    ("很", 1.5), ("挺", 1.3), ("蛮", 1.3), ("够", 1.3), ("太", 1.7),
    ("更加", 1.5), ("越发", 1.5), ("越来越", 1.5), ("加倍", 1.7), ("尤为", 1.7),
    ("最", 2.0), ("顶", 1.7), ("绝", 1.7), ("极", 1.8), ("超", 1.8),
    ("巨", 1.7), ("狂", 1.6), ("暴", 1.6), ("死", 1.5), ("坏", 1.5),
    ("真的", 1.4), ("真的太", 1.8), ("真的很", 1.6), ("真的非常", 1.9),
    ("so", 1.5), ("very", 1.6), ("extremely", 1.9), ("incredibly", 1.9),
    ("absolutely", 1.8), ("totally", 1.6), ("completely", 1.7), ("utterly", 1.8),
    ("highly", 1.7), ("greatly", 1.7), ("deeply", 1.6), ("strongly", 1.7),
    ("most", 1.9), ("more", 1.4), ("less", 0.7), ("little", 0.6), ("bit", 0.7),
]

# Negation words, in the order they are looked for.
NEGATIONS = [
    ("不", -1.0), ("没", -1.0), ("没有", -1.0), ("无", -1.0), ("非", -1.0),
    ("不是", -1.0), ("不要", -1.0), ("不能", -1.0), ("不会", -1.0), ("不可", -1.0),
    ("未曾", -1.0), ("未尝", -1.0), ("莫", -1.0), ("勿", -1.0), ("毋", -1.0),
    ("未必", -0.7), ("不见得", -0.7), ("不一定", -0.7), ("很难", -0.8),
    ("难以", -0.7), ("failed", -1.0), ("not", -1.0), ("n't", -1.0),
    ("no", -1.0), ("never", -1.0), ("none", -1.0), ("nobody", -1.0),
    ("nothing", -1.0), ("neither", -1.0), ("nor", -1.0), ("nowhere", -1.0),
    ("hardly", -0.8), ("scarcely", -0.8), ("barely", -0.8), ("rarely", -0.7),
    ("seldom", -0.7), ("without", -1.0), ("lack", -0.7), ("missing", -0.7),
    ("unable", -1.0), ("unlikely", -0.8), ("doubtful", -0.7),
]
NEGATED_POSITIVE = ["不", "没", "没有", "无", "非"]

# Sentence patterns with their weights.
PATTERNS = [
    ("(强烈|极力|重点|真心|特别|非常|超级|最|真的太|真的非常)(推荐|推|赞|支持|喜欢|满意)", 0.8),
    ("(好评|点赞|打call|给力|奥利给|yyds|YYDS|666)", 0.85),
    ("(物美价廉|物超所值|性价比高|划算|实惠|超值)", 0.8),
    ("(五星好评|满分|五星|全五星)", 0.85),
    ("(爱了|爱死|太爱|狂爱)", 0.85),
    ("(必买|必入|必选|必看|必听|必去)", 0.8),
    ("(神作|神级|神片|神曲|神颜)", 0.85),
    ("(天花板|yyds|永远的神)", 0.85),
    ("(收获满满|受益匪浅|大开眼界)", 0.8),
    ("(非常精彩|十分精彩|特别精彩|精彩绝伦)", 0.85),
    ("(非常优秀|十分优秀|特别优秀|极其优秀)", 0.85),
    ("(非常满意|十分满意|特别满意)", 0.8),
    ("(非常专业|十分专业|特别专业)", 0.8),
    ("(体验.*?(好|棒|赞|佳|优秀|不错)|非常.*?精彩|非常.*?优秀)", 0.7),
    ("(非常.*?美丽|非常.*?美好|非常.*?温暖|非常.*?温馨)", 0.8),
    ("(收获.*?(满满|很多|颇丰)|受益匪浅)", 0.75),
    ("(千万不要|千万别|别买|别入|别去|别看|别听)", -0.85),
    ("(垃圾|辣鸡|lj|LJ|乐色)", -0.85),
    ("(差评|一星|负分|零分)", -0.85),
    ("(坑|坑爹|坑人|被骗|被坑|上当)", -0.85),
    ("(后悔|悔不当初|肠子都悔青了)", -0.8),
    ("(垃圾产品|垃圾服务|垃圾质量)", -0.95),
    ("(投诉|举报|曝光|维权)", -0.8),
    ("(一生黑|永不回购|再也不买)", -0.85),
    ("(非常差|特别差|十分差|极其差|烂透了|糟糕透顶)", -0.9),
    ("(非常失望|十分失望|彻底失望|大失所望)", -0.9),
    ("(非常糟糕|特别糟糕|十分糟糕)", -0.9),
    ("(非常垃圾|特别垃圾|十分垃圾)", -0.95),
    ("(客服.*?(差|烂|糟|冷漠|敷衍|不专业)|态度.*?(差|烂|糟|恶劣))", -0.85),
    ("(物流.*?(慢|差|烂|糟糕)|配送.*?(慢|差|烂))", -0.75),
    ("(再也不|永不再|再也不会)", -0.85),
    ("(不推荐|不建议|不值得|不划算)", -0.8),
    (r"(Do\s+not\s+buy|dont\s+buy|do\s+not\s+waste|dont\s+waste|never\s+buy|never\s+again|"
     r"stopped\s+working|stopped\s+working|broke\s+after|cracked|broken|refund|unhelpful|rude|"
     r"delayed|worst\s+ever)", -0.85),
]
ENGLISH_PATTERNS = [
    ("highly (recommend|rated|impressive)", 0.85),
    ("would (definitely|certainly|gladly) (recommend|buy|use)", 0.75),
    ("(five|5) star(s)?", 0.75),
    ("(love|loved|adore) (it|this|so much)", 0.75),
    ("best (ever|i have ever had)", 0.75),
    ("worth (every|the) (penny|cent|money)", 0.75),
    ("would (never|not) (recommend|buy|use)", -0.75),
    ("(one|1) star(s)?", -0.75),
    ("waste (of|my) (time|money)", -0.75),
    ("(do not|don't|dont) (buy|purchase|waste)", -0.75),
    ("(worst|terrible|horrible|bad) (ever|i have ever had|experience)", -0.75),
    ("(total|complete) (waste|garbage|junk)", -0.75),
]

# Blends, bands and names.
BLEND = {"lexicon": 0.50, "pattern": 0.20, "sentence": 0.15, "emoji": 0.15}
BLEND_WITH_MODEL = {"lexicon": 0.35, "pattern": 0.15, "sentence": 0.15, "emoji": 0.05, "model": 0.30}
SENTENCE_ENDS = "。！？.!?；;\n"
SENTENCE_SPLIT = r"[。！？.!?；;\n]+"
WINDOW = {"chinese": 4, "english": 5}
