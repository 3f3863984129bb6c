"""Fixed values of the rule packs. They are configuration: every pack takes its own in their place."""

from __future__ import annotations

from dataclasses import dataclass, field

# ---- fixed values ----

PLACEHOLDERS = {
    "EMAIL": "XXXXX@XXXXX",
    "ADDRESS": "XX省XX市XX区XXXX",
    "ID_CARD": "XXXXXXXXXXXXXXXXXX",
    "BANK_CARD": "XXXXXXXXXXXXXXXX",
    "DATE": "YYYY/MM/DD",
    "DATE_CHINESE": "YYYY年MM月DD日",
    "MOBILE": "XXXXXXXXXXX",
    "PHONE": "0XX-XXXXXXXX",
    "BANK": "XX银行",
    "ORG": "XXXX",
    "NAME": "XXX",
    "AMOUNT": "[金额]",
    "IP": "X.X.X.X",
    "MAC": "XX:XX:XX:XX:XX:XX",
}
BANK_NAMES = (
    "中国工商银行 中国农业银行 中国银行 中国建设银行 交通银行 招商银行 浦发银行 兴业银行 民生银行 华夏银行 平安银行 光大银行 "
    "广发银行 浙商银行 渤海银行 恒丰银行 中国邮政储蓄银行 中国人民银行 北京银行 上海银行 南京银行 宁波银行 杭州银行 "
    "深圳前海微众银行 江苏银行 徽商银行 重庆银行 天津银行 成都银行 西安银行 苏州银行 武汉众邦银行 长沙银行 青岛银行 齐鲁银行 "
    "大连银行 盛京银行 哈尔滨银行 吉林银行 辽宁振兴银行 河北银行 廊坊银行 沧州银行 福建海峡银行 海峡银行 郑州银行 中原银行 "
    "焦作中旅银行 重庆三峡银行 重庆农村商业银行 成都银行 成都农商银行 贵州银行 贵阳银行 贵州农信 广西北部湾银行 "
    "广西农村合作金融机构 海南银行 海南省农信社 山西银行 晋商银行 甘肃银行 甘肃农信 内蒙古银行 内蒙古农信 新疆银行 新疆农信 "
    "农信社 信用社 农商银行 农村合作银行 村镇银行 农村商业银行 三山支行 福新支行 永兴支行 福州湖东支行 自贸区分行营业部 "
    "漳州云霄支行 龙岩新罗支行 厦门集美支行 福州滨海新城支行 福清玉融支行 福州江滨支行 福州广达支行 长乐支行 福州分行 漳州分行 "
    "龙岩分行 厦门分行 福州自贸区支行 福州闽侯支行 福州连江支行 福州罗源支行 福州平潭支行 莆田分行 泉州分行 三明分行 南平分行 "
    "宁德分行 福州台江支行 福州鼓楼支行 福州晋安支行 福州三山支行 福州福新支行 福州永兴支行 福州自贸区分行营业部 福州长乐支行 "
    "福州分行营业部 漳州分行营业部 龙岩分行营业部 厦门分行营业部 长汀支行 连江敖江支行 罗源支行 闽清支行 福州台江分行 "
    "福州仓山支行 漳州芗城支行 漳州龙文支行 厦门思明支行 厦门湖里支行 总行营业部"
).split()
SURNAMES = "詹欧赵钱孙李周吴郑王冯陈褚卫蒋沈韩杨朱秦尤许何吕施张孔曹严华金魏陶姜戚谢邹喻柏水窦章云苏潘葛奚彭郎鲁韦昌马苗凤花方俞任袁柳酆鲍史唐费廉岑薛雷贺倪汤滕殷罗毕郝邬常乐于时傅皮卞齐康伍余元卜顾孟平黄和穆萧尹姚邵湛汪祁毛禹狄米贝明臧伏成戴谈宋茅庞熊纪舒屈祝董梁杜阮蓝闵席季麻强贾路娄危江童颜郭梅盛林刁钟徐骆高夏蔡田樊胡凌霍虞万支柯昝卢莫房裘缪干解应宗丁宣邓单洪包诸左石崔吉钮龚林门龙段郑孔牛童浦施零厉刘卓曾廖"
NAME_CHARS = "伟强志建华文静宇轩浩然俊杰明辉晨曦鹏飞洪红霞丽娟秀英敏芳兰婷玉军平立德永海波涛清北胜利福生财腾广坤传王泓郭艳林微陈卓怡君佩瑶心如梦雨萱晓思彤欣涵晖润峰山宏翠冰勃项韬鑫昊毅春斌少凡梅娥昀铄智诗标芸仁铭侃楷肇乐曹潘李张欧詹郑丁周娜萍燕雅雯菲彩佳倩洁慧琳芬蓉澜蕊黛媛娇璐豪超刚勇磊龙荣逸朗天健自不息东宁瑀晶航皓钰行为"
BARE_BRANCH_SUFFIXES = ["分行", "支行", "营业部"]
BRANCH_SUFFIXES = ["支行", "营业部", "分行", "网点"]
#: Repairs of known wrong name matches: wrong, right.
REPAIRS = [("清XXX下", "清单如下"), ("营运XXX部", "营运计财部"), ("XXX务部", "计财财务部")]
#: Dates after these words become DUE_DATE.
DUE_WORDS = ["应为", "必须为", "须于"]
DUE_DATE = "XXXX年XX月XX日"
#: Protected phrases of pack g1, in the order in which they are protected.
PROTECTED_PHRASES = "建设领导小组 新核心项目建设领导小组 总体组 开发一组 开发二组 开发三组 开发四组 需求组 数据移植组 综合保障组 基础设施组 配置测试组 各项目组 合作公司".split()
PROTECTED_COMPANIES = ["有限公司", "合作公司"]
#: Pack g3: surnames of one character and of two.
SINGLE_SURNAMES = "李王张刘陈杨黄赵吴徐孙胡朱高林何郭马罗梁宋郑谢韩唐冯于董萧程曹袁邓许傅沈曾彭吕苏卢蒋蔡贾丁魏薛叶阎余潘杜戴夏钟汪田任姜范方石姚谭廖邹熊金陆郝孔白崔康毛邱秦江史顾侯邵孟龙万段雷钱汤尹黎易常武乔贺赖龚文安欧阮阳韦周柳舒栗亓代和洪鲜衣闵童焦鲁昌苗凤花俞酆鲍乐眭师滑"
COMPOUND_SURNAMES = (
    "欧阳 上官 司马 诸葛 东方 独孤 南宫 万俟 澹台 皇甫 尉迟 公羊 公冶 宗政 濮阳 单于 太叔 申屠 公孙 仲孙 轩辕 令狐 钟离 宇文 长孙 慕容 鲜于 闾丘 "
    "司徒 司空 亓官 司寇 子车 颛孙 端木 巫马 公西 漆雕 乐正 壤驷 公良 拓跋 夹谷 百里 东郭 南门 呼延 羊舌 微生 梁丘 左丘 东门 西门 夏侯"
).split()
#: Words after which a name match is none, and words that are no names themselves.
NOT_AFTER_NAME = (
    "公司 银行 支行 分行 部门 科室 处室 事务所 集团 联社 有限公司 股份有限公司 主任 经理 工程师 副局长 局长 副行长 行长 总经理 副总经理 董事长 副董事长 总监 副总监 "
    "项目部 事业部 工作组 小组 负责人 主送人 抄送人 编制人 审核人 批准人 审批人 主讲人 汇报人 接口人 联络人 经办人 填表人 录入人 作者 编辑 先生 女士 同志 老师 教授 "
    "新一代 信息系统 方案 介绍 马上 开始 流程 功能 储备 责任人 主办人"
).split()
NOT_NAMES = ["责任人", "马上", "负责人", "主办人"]
NOT_NAMES_WITH_BEFORE = ["责任人", "主办人", "承办人"]
NAME_LABELS = [
    "(?:姓名|姓名：|姓\\s*名\\s*[:：]?)\\s*",
    "(?:负责人|责任人|项目负责人|接口人|主讲人|汇报人|联系人|联络人|经办人)\\s*[:：]?\\s*",
    "(?:编制人|审核人|批准人|审批人|主送人|抄送人|作者|编辑|填表人|录入人)\\s*[:：]?\\s*",
]
#: Banks that packs g1 and g3 know by the words before 银行.
G1_BANKS = "中国 交通 招商 浦发 兴业 民生 华夏 平安 光大 广发 浙商 渤海 恒丰 农业 建设 工商 南京 宁波 杭州 深圳 上海 北京 广州 郑州 重庆 天津 成都 西安 苏州 武汉 长沙 青岛 济南 大连 沈阳 哈尔滨 长春 石家庄 福州 厦门 南昌 合肥 昆明 贵阳 南宁 海口 太原 兰州 呼和浩特 乌鲁木齐".split()
G1_LOOSE_BANKS = "农信社 信用社 农商银行 合作银行 人民银行 海峡 农商 城商 村镇 股份 合行".split()
G3_BANKS = "中国 交通 招商 浦发 兴业 民生 华夏 平安 光大 广发 浙商 渤海 恒丰 农业 建设 工商 南京 宁波 杭州 深圳 上海 北京 广州 郑州 中原 苏州 天津 重庆 成都 武汉 西安 长沙 济南 青岛 大连 沈阳 哈尔滨 长春 厦门 福州 贵阳 昆明 南宁 合肥 南昌 太原 石家庄 兰州 乌鲁木齐 呼和浩特 洛阳 开封 稠州 民泰 泰隆 紫金 江南 无锡 齐鲁".split()
G3_BANK_ENDS = "银行 农商银行 农村商业银行 信用社 农信社 合作银行 人民银行".split()
G3_BARE_BANKS = "农信社 信用社 农商银行 合作银行 人民银行 农村商业银行".split()
#: File endings by type of document.
FILE_TYPES = {
    "word": ["docx", "doc"], "excel": ["xlsx", "xls"], "ppt": ["pptx", "ppt"], "pdf": ["pdf"],
    "image": ["png", "jpg", "jpeg", "bmp", "gif", "tiff", "webp"],
}
OUTPUT_SUFFIX = "_脱敏"
#: Role words before a person's name (entity detection), and captures that are no names.
ROLE_PATTERNS = [
    "(?:总行|分行|支行)?(?:支持人员|联系人|负责人|行长|副行长|主管|经理|总监)[:：\\s]*",
    "(?:牵头|主办|参加)(?:行|社|公司|单位)[:：\\s]*",
    "(?:编写|审核|批准|签发)人[:：\\s]*",
    "[一-龥]{1,2}(?:行|社|公司)长[:：]\\s*",
    "(?:系统|项目)(?:负责人|经理|架构师|开发|测试)[:：\\s]*",
]
ROLE_EXCLUDED = "项目组 工作组 牵头行 主办行 参加行 总行 分行 支行 联社 系统 业务系统 核心系统".split()

# ---- end of fixed values ----


@dataclass(frozen=True)
class Lexicon:
    """What the rule packs are generated from."""

    placeholders: dict[str, str] = field(default_factory=lambda: dict(PLACEHOLDERS))
    bank_names: tuple[str, ...] = tuple(BANK_NAMES)
    surnames: str = SURNAMES
    name_chars: str = NAME_CHARS
    org_suffixes: tuple[str, ...] = ()
    bare_branches: tuple[str, ...] = tuple(BARE_BRANCH_SUFFIXES)
    #: characters of given names of pack g3
    given_chars: str = NAME_CHARS
