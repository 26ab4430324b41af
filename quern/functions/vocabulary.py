"""Fixed values of the retrieval and query-understanding jobs: word lists, weights, patterns and limits."""

from __future__ import annotations

# Words of a query that mark its kind.
COMMAND_WORDS = ("config", "configuration", "配置", "show", "list", "列出", "显示", "set", "add", "del", "delete", "nvue", "如何使用")
COMMAND_PATTERN = r"nv\s+(set|show|config|unset|action)"
CONCEPT_WORDS = ("what is", "explain", "concept", "definition", "intro", "介绍", "什么是", "概念", "原理", "解释")
TROUBLE_WORDS = ("debug", "fix", "issue", "problem", "fail", "error", "调试", "故障", "错误", "问题", "排错", "怎么办", "起不来")

# Words and patterns of a chunk that answer each kind.
COMMAND_CONTENT = ("nv config", "nv show", "nv set")
COMMAND_CONTENT_PATTERN = r"(nv|show|netq|vtysh)\s+(config|show|ip|interface|platform)"
CONCEPT_CONTENT_PATTERN = r"\sis a\s|\srefers to\s|\sdescribes\s|是.*(?:一种|一个|用于)|指的是|定义为"
TROUBLE_CONTENT = ("error", "fail", "failure", "down", "drop", "discard", "troubleshoot", "debug", "log", "problem", "issue")

# Default expansion of query terms. A caller may pass a larger table.
EXPANSIONS = {
    "配置": ("config", "configuration", "settings", "setup", "provisioning", "set"),
    "config": ("配置", "设置"),
    "显示": ("show", "display", "view", "list", "get", "print"),
    "列出": ("list", "show", "ls", "display", "enumerate"),
    "查看": ("check", "view", "show", "display", "inspect"),
    "状态": ("status", "state", "health", "condition", "info", "summary"),
    "命令": ("command", "cli", "cmd", "instruction", "nv", "nvue", "netq", "vtysh"),
    "保存": ("save", "write", "commit", "store"),
    "重启": ("reboot", "reload", "restart", "reset"),
    "删除": ("delete", "remove", "unset", "clear", "erase", "no"),
    "开启": ("enable", "up", "start", "activate", "on"),
    "关闭": ("disable", "down", "stop", "deactivate", "off", "shutdown"),
    "调试": ("debug", "trace", "log", "monitor"),
    "升级": ("upgrade", "update", "install", "patch"),
    "连接": ("connect", "ssh", "telnet", "console", "link"),
    "所有": ("all", "full", "entire", "everything", "total", "whole"),
    "设备": ("device", "system", "switch", "router", "box", "hardware", "platform", "node", "chassis"),
    "当前": ("current", "currently", "active", "running", "applied", "now"),
    "接口": ("interface", "port", "int", "eth", "swp"),
    "路由": ("route", "routing", "rib", "fib", "forwarding"),
    "网络": ("network", "net", "fabric", "infrastructure"),
    "版本": ("version", "ver", "revision", "release", "image"),
    "用户": ("user", "username", "account", "admin", "role"),
    "密码": ("password", "passwd", "secret", "credential", "auth"),
    "邻居": ("neighbor", "peer", "adjacency"),
    "日志": ("log", "logging", "syslog", "journal"),
    "错误": ("error", "fail", "failure", "drop", "discard", "loss", "down"),
    "起不来": ("down", "fail", "failure", "not established"),
    "怎么办": ("troubleshoot", "fix", "solution", "how to", "debug"),
    "bgp": ("border gateway protocol", "ebgp", "ibgp"),
    "ospf": ("open shortest path first",),
    "evpn": ("ethernet vpn", "vxlan"),
    "vxlan": ("virtual extensible lan", "vni", "vtep", "overlay"),
    "vni": ("virtual network identifier", "segment id"),
    "mlag": ("multi-chassis link aggregation", "clag", "bond", "peer-link", "peerlink", "dual-connected", "mlag-id", "backup-ip"),
    "nv set": ("nv config", "nvue", "nv set interface", "nv set system", "nv set mlag", "nv set bridge", "nv set router", "nv set evpn", "nv set vrf"),
    "nvue": ("nv set", "nv show", "nv config", "nv unset", "nv action"),
    "nv": ("nvue", "nv set", "nv show", "nv config", "nv unset"),
    "stp": ("spanning tree", "rstp", "mstp", "pvst"),
    "lacp": ("link aggregation", "bond", "port-channel", "lag"),
    "lldp": ("link layer discovery",),
    "vlan": ("virtual lan", "bridge", "dot1q"),
    "vrf": ("virtual routing and forwarding", "vpn-instance"),
    "acl": ("access control list", "filter", "policy", "rule"),
    "bfd": ("bidirectional forwarding detection",),
    "ptp": ("precision time protocol", "1588"),
    "snmp": ("simple network management protocol", "trap", "inform"),
    "ntp": ("network time protocol", "time"),
    "dhcp": ("dynamic host configuration protocol", "relay"),
    "dns": ("domain name system", "resolve", "nameserver"),
}

# Words of a query that shift the fusion's weights.
FUSION_COMMAND_WORDS = ("配置", "命令", "config", "show", "how to", "如何")
FUSION_COMMAND_PATTERN = r"nv\s+(set|show|config|unset)"
FUSION_TECH_WORDS = ("mlag", "bgp", "evpn", "vxlan", "ospf", "lacp", "bond", "cumulus")

# Intents with weight, keywords and patterns.
INTENTS = (
    ("command", 1.2, ("执行", "how to", "how do", "run", "execute", "运行", "nv show", "show", "display", "list", "get", "查询"), (r"^(如何|怎么|怎样).*(查询|执行|运行|操作|显示|查看|配置|设置)", r"^(nv show|show|display|list|get)\s")),
    ("troubleshoot", 1.3, ("问题", "错误", "失败", "不工作", "无法", "异常", "error", "fail", "issue", "problem", "not working", "debug", "调试", "排查", "诊断", "起不来", "启不动", "无法启动", "启动失败", "不能启动", "报错"), (r"^(为什么|为啥).*(不|无法|失败|错误)", r"^(.*)(出错|报错|异常|问题|故障|起不来|启不动|无法启动|启动失败)", r"^(debug|troubleshoot|diagnose)", r"(报错|出错|异常).*(如何|怎么|怎样|调试)")),
    ("configuration", 1.0, ("配置", "设置", "启用", "禁用", "修改", "更改", "configure", "setup", "enable", "disable", "set", "modify", "nv set", "nv config"), (r"^(配置|设置|启用|禁用|修改|更改)\s+\w+", r"^(nv set|nv config)", r"^(enable|disable|configure)\s", r"(启用|禁用).*(如何|怎么|怎样)", r"(如何|怎么|怎样).*(启用|禁用|配置|设置)")),
    ("explanation", 0.9, ("什么是", "定义", "说明", "原理", "解释", "介绍", "what is", "definition", "explain", "describe", "详细", "详解"), (r"^(什么是|什么叫|定义).*", r"^(explain|describe|define)", r"^(.*)(的原理|的概念|的含义)")),
    ("comparison", 0.8, ("对比", "区别", "差异", "优缺点", "比较", "vs", "versus", "difference", "compare", "相比", "不同"), (r"^(对比|比较|区别).*(和|与|vs)", r"^(.*)(vs|versus|和.*的区别)")),
    ("performance", 0.9, ("优化", "性能", "调优", "提升", "加速", "改进", "optimize", "performance", "tune", "improve", "效率"), (r"^(如何|怎么|怎样).*(优化|提升|改进|加速)", r"^(optimize|performance|tune)", r"(提升|优化|改进|加速).*(如何|怎么|怎样)")),
    ("best_practice", 0.85, ("推荐", "建议", "标准", "最佳", "最好", "best practice", "recommend", "suggest", "应该", "通常"), (r"^(推荐|建议|最佳|标准).*", r"^(best practice|recommended)")),
    ("verification", 0.95, ("检查", "验证", "查看", "显示", "查询", "check", "verify", "show", "display", "list", "nv show"), (r"^(检查|验证|查看|查询).*(状态|配置|结果|设置)", r"^(nv show|show|display|list)", r"^(查看|显示).*")),
    ("question", 0.8, ("为什么", "是否", "能否", "可以", "会不会", "why", "whether", "can", "could", "吗"), (r"^(为什么|为啥).*", r"^(是否|能否|可以).*", r".*[吗？\?]$")),
)
# The first pattern that recent turns match gives the context's intent.
CONTEXT_INTENTS = (
    ("troubleshoot", r"error|fail|problem|issue|错误|问题|失败"),
    ("configuration", r"configure|setup|enable|disable|配置|设置|启用|禁用"),
    ("explanation", r"why|reason|explain|为什么|原因|解释"),
    ("performance", r"performance|optimize|improve|性能|优化|提升"),
)
ERROR_PATTERN = r"error|fail|problem|issue|异常|错误|问题"
COMMAND_HINT_PATTERN = r"show|set|config|enable|disable|nv|command"
PARAMETER_PATTERN = r"\d+|[a-f0-9]{2}:[a-f0-9]{2}|/\d+"
CONDITION_PATTERN = r"和|或|同时|另外|此外"

# Retrieval limit, rerank candidates and least score of each intent.
RETRIEVAL = {
    "command": (20, 60, 0.45),
    "troubleshoot": (25, 60, 0.48),
    "configuration": (20, 60, 0.50),
    "explanation": (15, 60, 0.55),
    "comparison": (25, 60, 0.50),
    "performance": (20, 60, 0.50),
    "best_practice": (20, 60, 0.52),
    "verification": (20, 60, 0.48),
    "question": (20, 60, 0.55),
    "general": (20, 60, 0.55),
}

# Constant of reciprocal rank fusion by intent.
FUSION_CONSTANTS = {"command": 40, "configuration": 50, "troubleshoot": 45, "explanation": 70, "question": 65, "general": 60, "network_config": 45, "verification": 50, "comparison": 65, "performance": 60, "best_practice": 65}

# Words that send a query to the domain expansion.
ROUTING_WORDS = ("pfc", "ecn", "roce", "qos", "bgp", "routing", "配置", "configure")

# Stop words of keyword extraction.
STOP_WORDS = tuple(
    "the a an and or but in on at to for of with by 如何 怎么 怎样 什么 哪个 哪些 为什么 是否 能否 可以 应该 的 了 在 是 我 有 和 就 不 人 都 一 一个 上 也 很 到 说 要 去 你 会 着 没有 看 好 自己 这 那 些 个 只 现在 请 问".split()
)
DOMAIN_STOP_WORDS = tuple("的 了 在 是 我 有 和 就 不 人 都 一 一个 上 也 很 到 说 要 去 你 会 着 没有 看 好 自己 这 那 些 个 只 现在 请 问 怎么 如何 怎样 什么 哪个 哪些 为什么 是否 能否 可以 应该 给出 完整".split())

# Words of semantic groups, of commands, their actions and targets (the first that fits).
SEMANTIC_GROUPS = {
    "network_config": ("network", "configure", "setup", "interface", "vlan", "routing", "subnet", "gateway", "dns", "dhcp"),
    "access_control": ("access", "control", "permission", "allow", "deny", "permit", "block", "restrict", "acl", "firewall"),
    "security": ("security", "secure", "encrypt", "authentication", "authorization", "ssl", "tls", "vpn"),
    "monitoring": ("monitor", "log", "alert", "status", "health", "performance", "metric"),
}
COMMANDS = ("acl", "access-list", "ip", "interface", "route", "vlan", "firewall", "switch", "router")
ACTIONS = (("configure", ("配置", "config", "设置")), ("enable", ("启用", "enable", "开启")), ("disable", ("禁用", "disable", "关闭")), ("delete", ("删除", "delete", "移除")))
TARGETS = (("access-control", ("访问控制", "acl")), ("routing", ("路由",)), ("interface", ("接口", "interface")), ("vlan", ("vlan",)), ("firewall", ("防火墙", "firewall")))

# Domain terms by category, and the words each recognised technology adds to a query.
DOMAIN_TERMS = {
    "pfc": ("pfc", "priority flow control", "priority-based flow control", "802.1bb", "link pause", "queue pause"),
    "ecn": ("ecn", "explicit congestion notification", "congestion control", "red", "wred", "random early detection"),
    "roce": ("roce", "rdma over converged ethernet", "rdma", "lossless ethernet"),
    "qos": ("qos", "quality of service", "traffic class", "traffic priority", "cos", "dscp"),
    "bgp": ("bgp", "border gateway protocol", "ebgp", "ibgp", "neighbor", "peer", "as", "autonomous system", "asn"),
    "routing": ("route", "router", "routing", "ip route", "static route"),
}
VENDORS = ("nvidia", "mellanox", "cumulus", "broadcom", "思科", "cisco", "nv", "nvos")
CONFIG_TERMS = ("configure", "configuration", "setup", "enable", "disable", "show", "set", "apply", "nv", "acl", "access control list")
DOMAIN_FLAGS = (("has_pfc", ("pfc", "priority flow control")), ("has_ecn", ("ecn", "explicit congestion notification")), ("has_roce", ("roce", "rdma")), ("has_bgp", ("bgp", "border gateway protocol")), ("has_qos", ("qos", "quality of service")))
DOMAIN_ADDS = (
    ("has_pfc", ("pfc", "priority flow control", "802.1bb", "queue pause", "link pause")),
    ("has_ecn", ("ecn", "explicit congestion notification", "congestion control", "red", "wred")),
    ("has_roce", ("roce", "rdma", "rdma over converged ethernet", "lossless ethernet")),
    ("has_bgp", ("bgp", "border gateway protocol", "ebgp", "ibgp", "neighbor", "router bgp")),
)
ACL_ADDS = ("acl", "access control list", "ip access-list", "ipv6 access-list", "permit", "deny", "rule", "nv set acl", "nv config acl")
QOS_ADDS = ("qos", "quality of service", "traffic class", "traffic priority")
VENDOR_ADDS = ("nvidia", "mellanox", "cumulus", "nvos")
ALWAYS_ADDS = ("configure", "configuration", "setup", "enable", "command", "cli")
CONFIG_ADDS = ("nv set", "nv config", "net add")

# Terms listed in a chunk's summary.
SUMMARY_TERMS = (
    "BGP|OSPF|EVPN|VXLAN|MLAG|CLAG|STP|LACP|LLDP|VLAN|VRF|ACL|BFD|PTP|SNMP|NTP|DHCP|DNS",
    "PFC|ECN|RDMA|RoCE|DCQCN|QoS|CoS|DSCP",
    r"swp\d+|eth\d+|bond\d+|bridge|vni\d+|peerlink",
)
SUMMARY_COMMANDS = r"nv\s+(?:set|show|config|unset|action)\s+[^\n]+"

# Openings of statements that need no source.
GENERIC_OPENINGS = r"^(根据|基于|按照|根据参考|感谢|谢谢|希望|祝|如果|当|假如|假设|总之|总结|综上|更多|详细|具体)"
