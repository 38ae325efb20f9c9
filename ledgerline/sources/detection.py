"""Detection rules as a table: which texts in a statement's first lines and body tell its layout. Adding a rule adds a row.

A rule fits if all its header words are in the header and all others anywhere in the text (both without blanks); the first
that fits wins, so rules of one issuer's own layout come before those of a name that others may mention.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "ord int, bank_id string, scope string, header_markers array<string>, markers array<string>, label string, confidence int, reason string"

# Layout, confidence, words of the header, words of the text.
RULES = [
    ("tianjin_corp", 98, ["天津银行对公交易明细清单", "借方发生额", "贷方发生额"], []),
    ("guangxi_rural", 98, ["账户交易明细", "序号交易时间对方户名对方账号对方行名币种收入/支出金额账户余额用途摘要附言备注"], []),
    ("hengfeng", 98, ["恒丰银行交易流水", "记账日期货币交易金额联机余额"], []),
    ("tiantai_rural", 98, ["个人账户交易明细", "开户行:天台农商银行", "交易金额账户余额"], []),
    ("mintai", 98, ["个人账务明细", "账/卡号", "交易日期收入金额支出金额余额对方户名对方账号交易摘要"], []),
    ("yongxing_rural", 98, ["湖南永兴农村商业银行股份有限公司交易明细", "交易时间交易金额账户余额对方账号对方户名摘要备注"], []),
    ("mengshang", 98, ["蒙商银行个人活期账户全部交易明细", "交易日期交易金额账户余额"], []),
    ("ordos", 98, ["个人活期存款账户交易明细", "总收入笔数", "交易时间收入(元)支出(元)余额(元)币种对方账号对方户名备注"], []),
    ("qingdao_rural_corp", 98, ["开户行：青岛农商银行", "记账日期交易金额账户余额交易摘要交易对手信息"], []),
    ("hebei_rural", 98, [], ["河北省农村信用社联合社", "账户历史明细清单", "总条数", "序号交易日期交易金额金额对方户名对方账号摘要网点来源"]),
    ("chengdu_corp", 98, [], ["交易参考号交易日期收入支出余额对方账号对方户名对方行名用途", "汇总笔数", "收入总计", "支出总计", "时间区间"]),
    ("huaxia", 98, ["个人账户交易流水(电子版)"], ["记账日期摘要收入金额支出金额余额交易机构", "对方姓名对方卡/账号对方开户行附言"]),
    ("hubei_rural", 98, ["湖北农商银行-个人手机银行交易明细"], ["交易日期", "对方账号/卡号", "发生额余额币种"]),
    ("changsha", 98, ["个人账户明细对账单"], ["StatementofPersonalAccount", "交易日期交易金额账户余额对方户名对方账号摘要/备注"]),
    ("chaoyang_corp", 98, ["交易明细表", "账号:", "户名:"], ["交易日期交易时间收入/支出交易金额账户余额对方户名对方账户对方行名(支行)交易摘要"]),
    ("boc_corp_v2", 98, ["账户历史明细", "账户明细列表", "交易日期支出(借)收入(贷)余额", "交易对手账号交易对手名称交易对手行名摘要附言"], []),
    ("bazhou_shunfeng_corp", 98, ["霸州舜丰村镇银行企业账户交易明细"], ["汇出金额汇入金额余额摘要用途"]),
    ("hebei_corp_detail", 98, ["交易明细记录", "收支标识"], ["交易日期交易金额借贷标志交易后余额", "交易对手账号交易对手名称交易对手开户行摘要备注"]),
    ("hebei_personal", 96, ["账户历史交易明细清单"], ["客户账号", "账户名称", "交易日期借贷交易金额账户余额", "对方账户对方户名流水号摘要备注"]),
    ("huishang_corp", 98, ["徽商银行", "账户交易明细", "账户/户名"], ["交易时间收入金额支出金额账户余额对方账号对方户名对方开户行用途流水号附言摘要"]),
    ("huishang", 98, [], ["TransactionStatementofHuishangBank", "DateCurrencyTransactionBalanceChannelTransactionTypeCounterParty"]),
    ("dezhou_corp", 98, ["单位活期存款账户交易明细", "收入总金额"], ["交易时间交易渠道收入支出账户余额"]),
    ("qingdao_corp", 98, ["青岛银行交易流水"], ["交易日期交易类型收入金额支出金额余额"]),
    ("shanxi_bank_corp", 98, ["账户交易明细"], ["山西银行股份有限公司", "交易日期摘要交易金额账户余额"]),
    ("lanzhou", 98, ["兰州银行个人账户对账单打印"], ["交易日期收入/支出金额余额"]),
    ("jinan_rural_corp", 98, ["交易流水", "开户行：济南农商银行", "账户名称"], ["记账日期交易金额账户余额交易摘要交易对手信息"]),
    ("shouguang_rural_corp", 98, ["交易流水", "开户行：寿光农村商业银行", "账户名称"], ["记账日期交易金额账户余额交易摘要交易对手信息"]),
    ("luzhou", 98, ["泸州银行账户历史明细清单", "客户名称", "总条数"], ["序号交易时间币种交易金额账户余额对方账号对方户名交易类型摘要交易渠道"]),
    ("generic_pdf", 92, [], ["明细账查询", "交易日期", "支出金额", "收入金额", "账户余额", "交易名称", "对方账号", "对方户名"]),
    ("cmb_corp", 98, ["用户所属公司", "记录数"], ["交易日期借方(出账)贷方(入账)余额摘要", "收(付)方名称", "收(付)方账号", "交易类型"]),
    ("customer_detail_corp", 96, ["对公客户账户明细", "客户名称"], ["交易日期交易发生金额账户余额对方账号对方户名摘要备注", "借方合计笔数", "贷方合计笔数"]),
    ("everbright", 98, [], ["TransactionStatementofChinaEverbrightBank", "TransAmtDr", "TransAmtCr", "AccountBalance"]),
    ("everbright_corp", 98, [], ["光大", "对公", "借方发生额", "贷方发生额", "借方笔数", "贷方笔数", "序号交易日期时间借/贷交易金额账户余额"]),
    ("cib", 92, [], ["BankTransactionDetails", "兴业", "支出", "收入"]),
    ("boc_corp", 98, ["中国银行", "单位人民币活期"], ["借方发生额", "贷方发生额", "承前页余额"]),
    ("boc_corp", 98, ["查询账号", "总笔数", "借方发生", "贷方发生"], ["交易类型业务类型", "交易日期交易时间交易货币交易金额交易后余额", "中国银行"]),
    ("boc", 98, ["中国银行交易流水明细清单"], ["记账日期记账时间币别金额余额交易名称", "借记卡号"]),
    ("psbc", 98, ["中国邮政储蓄银行账户交易明细"], ["支出金额收入金额余额"]),
    ("icbc_corp", 98, ["中国工商银行账户明细清单"], ["本方账号户名", "转入金额", "转出金额"]),
    ("bocom_corp", 98, ["交通银行", "明细对账单"], ["会计日期交易日期交易名称", "借方发生额贷方发生额余额"]),
    *[("shanghai_corp", 98, [title], [sign, columns]) for title in ("账户明细对账单", "账户明细查询") for sign in ("上海银行", "交易流水号交易时间记账日期交易方向", "序号交易时间借方金额贷方金额余额") for columns in ("借方金额贷方金额余额", "借方发生额贷方发生额余额")],
    ("shanghai", 98, ["上海银行交易明细"], ["TransactionDetails", "交易金额期末金额"]),
    ("alipay", 98, [], ["支付宝支付科技有限公司交易流水证明", "收/支交易对方商品说明收/付款方式金额"]),
    ("shengjing", 98, ["盛京银行交易流水"], ["TransactionStatementofShengjingBank"]),
    ("xingtai", 98, ["邢台银行账户交易明细"], ["收入/支出交易金额（元）余额（元）"]),
    ("sichuan_rural", 98, ["四川省农村信用社账户交易明细"], ["交易日期交易时间币种交易金额账户余额"]),
    ("gansu", 98, [], ["甘肃银行账户交易流水", "卡号/账号", "收入/支出"]),
    ("shanxi_rural_corp", 98, ["账户交易明细导出"], ["交易时间分账号收入金额支出金额账户余额"]),
    ("mengshang_corp", 98, ["蒙商银行活期账户明细信息"], ["借方发生额贷方发生额余额"]),
    ("fuxin_corp", 98, ["阜新银行客户明细对账单"], ["借方发生额贷方发生额余额"]),
    ("ccb_corp", 98, ["中国建设银行账户明细信息"], ["借方发生额", "贷方发生额", "余额"]),
    ("cib", 96, [], ["兴业银行交易明细", "IndustrialBankTransactionDetails"]),
    ("huaxia", 98, ["华夏银行个人账户交易流水"], ["HuaxiaBankPersonalTransactionStatement", "交易金额余额"]),
    ("pingan", 98, [], ["平安银行个人账户交易明细清单", "TransactionDetailsListofPersonalAccountofPinganBank", "交易金额余额交易地点摘要"]),
    ("pingan", 92, [], ["清单编号", "ListNumber", "交易金额余额交易地点摘要备注", "CounterpartyInformation"]),
    ("pingan", 90, [], ["平安银行", "清单编号", "交易金额余额交易地点摘要备注"]),
    ("cib", 92, [], ["兴业银行交易明细", "交易金额", "账户余额"]),
    ("citic_corp", 95, ["账户交易明细"], ["柜员交易号", "动账资金分簿", "借方发生额", "贷方发生额", "余额"]),
    ("cmb_corp", 98, ["账务明细清单", "StatementOfAccount"], ["招商银行"]),
    ("customer_account_corp", 92, ["客户账户明细对账单"], ["账号/卡号", "交易日期摘要借方金额贷方金额余额币种对方账号/户名用途", "借方总笔数"]),
    ("zhongyuan", 98, ["账户交易流水"], ["中原银行", "收支状态"]),
    ("chengdu_rural_corp", 98, ["客户明细"], ["成都农村商业银行", "借方金额贷方金额余额"]),
    ("chongqing", 98, ["重庆银行账户交易明细"], ["交易金额活期账面余额交易类型/摘要"]),
    ("guilin_corp", 98, ["桂林银行企业客户交易清单"], ["交易日期对方账号对方户名收入支出余额"]),
    ("guilin", 96, ["桂林银行"], ["交易日期对方账号对方户名收入（元）支出（元）账户余额（元）备注"]),
    ("mybank_corp", 98, ["浙江网商银行企业账户交易明细"], ["借方金额（收）贷方金额（支）余额"]),
    ("tianjin_rural_corp", 98, ["交易明细查询"], ["天津农村商业银行", "交易日期收入支出余额对方户名对方账号对方开户行摘要备注"]),
    ("rural_commercial", 96, ["卡号/账号", "客户名称", "总收入", "总支出"], ["序号摘要币别钞汇交易日期交易金额账户余额"]),
]
# Layout, one word of the text, confidence.
SINGLE = [
    ("icbc_corp", "借/贷借方发生额贷方发生额", 98), ("icbc_corp", "凭证号对方账号交易时间借贷标志", 98), ("icbc_corp", "中国工商银行企业存款对账单", 98), ("wechat", "微信支付交易明细证明", 98), ("wechat", "微信支付账单", 95),
    ("wechat", "交易时间交易类型交易对方商品收/支金额", 95), ("abc_corp", "交易时间收入金额支出金额账户余额", 98), ("abc", "对私客户账户明细", 98), ("abc", "交易日期交易时间交易摘要交易金额本次余额", 98), ("icbc", "中国工商银行借记账户历史明细", 98),
    ("icbc", "交易日期账号储种序号币种钞汇摘要地区收入/支出金额余额", 95), ("spdb", "上海浦东发展银行个人客户交易流水专用回单", 98), ("spdb", "TransactionStatementofShanghaiPudongDevelopmentBank", 95), ("spdb_corp", "上海浦东发展银行电子对账单", 98),
    ("spdb_corp", "ShanghaiPudongDevelopmentBankElectronicStatement", 95), ("bocom", "交通银行个人客户交易清单", 95), ("psbc", "中国邮政储蓄银行借记账户历史明细", 95), ("qilu_corp", "单位活期存款账户交易明细", 98),
    ("rural_credit", "交易流水号交易日期交易网点收入/支出交易金额实时余额", 95), ("cmb_corp", "账务明细清单StatementOfAccount", 98), ("cmb", "TransactionStatementofChinaMerchantsBank", 95), ("citic", "账户交易明细Transactiondetails", 95),
    ("citic", "交易日期收入金额支出金额账户余额交易摘要", 90), ("jiujiang", "九江银行交易流水", 90), ("ningbo", "宁波银行交易流水", 90), ("lanzhou", "兰州银行对公账户对账单", 90), ("foshan_rural", "佛山农村商业银行", 90), ("nanjing_corp", "南京银行对公账户交易明细", 90),
    ("cmbc_corp", "单位账户对账单客户名称客户账号", 98), ("cmbc_corp", "单位账户对账单", 95), ("cmbc", "个人账户对账单客户姓名客户账号", 95), ("cmbc", "中国民生银行股份有限公司", 95), ("cib", "IndustrialBankTransactionDetails", 95), ("cib", "兴业银行交易流水", 95),
    ("ccb_corp", "中国建设银行股份有限公司活期存款明细账", 98), ("ccb_corp", "中国建设银行账户明细信息", 95), ("ccb", "中国建设银行个人活期账户交易明细", 96), ("ccb", "中国建设银行个人活期账户全部交易明细", 95),
    ("abc", "中国农业银行银行卡交易明细清单", 95), ("abc", "中国农业银行账户活期交易明细清单", 85), ("icbc", "中国工商银行账户明细清单", 85),
]
# Weak rules at the end: layout, confidence, scope, words.
WEAK = [("icbc_corp", 75, "body", ["交易时间", "余额", "中国工商银行"]), ("cmb", 80, "top", ["招商银行"])]
#: Characters that stand in this order in the header, and how far apart at most: read through a watermark.
ORDERED = [("cib", "兴业银行交易流水", None), ("cib", "兴业银行交易明细", 120)]
#: Fixed value: an issuer's name that becomes part of the label.
ISSUER = r"([一-龥]{2,20}农村商业银行)"


def rules() -> list[tuple]:
    out = [(b, "body", header, markers, c, "layout") for b, c, header, markers in RULES]
    out += [(b, "body", [], [m], c, f"keyword: {m}") for b, m, c in SINGLE]
    out += [(b, scope, [], markers, c, "weak") for b, c, scope, markers in WEAK]
    return [(k, b, scope, header, markers, b, c, why) for k, (b, scope, header, markers, c, why) in enumerate(out, 1)]


def detection_rules(spark: SparkSession) -> DataFrame:
    """The rules as a table; the label is the layout's name until ``text.bank_name`` or the caller's table gives another."""
    return spark.createDataFrame(rules(), SCHEMA)
