"""Term lists of the keyword classifier. Fixed values; pass others to override."""

RED_TEAM_TERMS = (
    "red team", "c2", "command and control", "cobalt strike", "sliver",
    "lateral movement", "edr evasion", "edr bypass", "post-exploitation",
    "beacon", "offensive security",
)

VULN_TERMS = (
    "vulnerability", "zero-day", "0-day", "exploit", "rce",
    "remote code execution", "privilege escalation", "authentication bypass",
    "flaw", "patch",
)

ZERO_DAY_TERMS = ("zero-day", "0-day", "zero day")

HIGH_RELEVANCE_TERMS = (
    "windows", "microsoft", "active directory", "exchange", "linux kernel",
    "vmware", "esxi", "hypervisor", "chrome", "firefox", "ivanti", "fortinet",
    "palo alto", "citrix", "cisco", "vpn", "firewall", "exploited in the wild",
    "actively exploited", "zero-day", "0-day", "zero day",
)

LOW_RELEVANCE_TERMS = (
    "plugin", "wordpress", "drupal", "joomla", "theme", "extension", "add-on",
    "addon",
)
