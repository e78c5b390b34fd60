"""Scheduled tasks that the system itself brings and where their commands lie, and names of attack techniques."""

from __future__ import annotations

# Task path, and the beginnings of its command, lower-cased, with variables expanded.
KNOWN_TASKS = (
    ("\\Microsoft\\Windows\\UpdateOrchestrator\\Schedule Scan", ("c:\\windows\\system32\\usoclient.exe", "c:\\windows\\system32\\mousocoreworker.exe",)),
    ("\\Microsoft\\Windows\\UpdateOrchestrator\\Schedule Wake To Work", ("c:\\windows\\system32\\usoclient.exe",)),
    ("\\Microsoft\\Windows\\UpdateOrchestrator\\Reboot", ("c:\\windows\\system32\\usoclient.exe",)),
    ("\\Microsoft\\Windows\\UpdateOrchestrator\\Report policies", ("c:\\windows\\system32\\usoclient.exe",)),
    ("\\Microsoft\\Windows\\WindowsUpdate\\Scheduled Start", ("c:\\windows\\system32\\usoclient.exe",)),
    ("\\Microsoft\\Windows\\Windows Defender\\Windows Defender Scheduled Scan", ("c:\\program files\\windows defender\\mpcmdrun.exe",)),
    ("\\Microsoft\\Windows\\Windows Defender\\Windows Defender Cache Maintenance", ("c:\\program files\\windows defender\\mpcmdrun.exe",)),
    ("\\Microsoft\\Windows\\Windows Defender\\Windows Defender Cleanup", ("c:\\program files\\windows defender\\mpcmdrun.exe",)),
    ("\\Microsoft\\Windows\\Windows Defender\\Windows Defender Verification", ("c:\\program files\\windows defender\\mpcmdrun.exe",)),
    ("\\Microsoft\\Windows\\Defrag\\ScheduledDefrag", ("c:\\windows\\system32\\defrag.exe",)),
    ("\\Microsoft\\Windows\\Application Experience\\Microsoft Compatibility Appraiser", ("c:\\windows\\system32\\compattelrunner.exe",)),
    ("\\Microsoft\\Windows\\Application Experience\\ProgramDataUpdater", ("c:\\windows\\system32\\compattelrunner.exe",)),
    ("\\Microsoft\\Windows\\Application Experience\\StartupAppTask", ("c:\\windows\\system32\\wsqmcons.exe", "c:\\windows\\system32\\",)),
    ("\\Microsoft\\Windows\\Customer Experience Improvement Program\\Consolidator", ("c:\\windows\\system32\\wsqmcons.exe",)),
    ("\\Microsoft\\Windows\\Customer Experience Improvement Program\\KernelCeipTask", ("c:\\windows\\system32\\",)),
    ("\\Microsoft\\Windows\\Customer Experience Improvement Program\\UsbCeip", ("c:\\windows\\system32\\",)),
    ("\\Microsoft\\Windows\\.NET Framework\\.NET Framework NGEN v4.0.30319", ("c:\\windows\\microsoft.net\\framework\\v4.0.30319\\ngen.exe",)),
    ("\\Microsoft\\Windows\\.NET Framework\\.NET Framework NGEN v4.0.30319 64", ("c:\\windows\\microsoft.net\\framework64\\v4.0.30319\\ngen.exe",)),
    ("\\Microsoft\\Windows\\Chkdsk\\ProactiveScan", ("c:\\windows\\system32\\chkdsk.exe",)),
    ("\\Microsoft\\Windows\\DiskCleanup\\SilentCleanup", ("c:\\windows\\system32\\cleanmgr.exe",)),
    ("\\Microsoft\\Windows\\Maintenance\\WinSAT", ("c:\\windows\\system32\\winsat.exe",)),
    ("\\Microsoft\\Windows\\TaskScheduler\\Maintenance Configurator", ("c:\\windows\\system32\\",)),
    ("\\Microsoft\\Windows\\Time Synchronization\\SynchronizeTime", ("c:\\windows\\system32\\sc.exe", "c:\\windows\\system32\\w32tm.exe",)),
    ("\\Microsoft\\Windows\\Time Synchronization\\ForceSynchronizeTime", ("c:\\windows\\system32\\sc.exe", "c:\\windows\\system32\\w32tm.exe",)),
    ("\\Microsoft\\Windows\\Windows Error Reporting\\QueueReporting", ("c:\\windows\\system32\\wermgr.exe",)),
    ("\\Microsoft\\Windows\\Registry\\RegIdleBackup", ("c:\\windows\\system32\\regidle.dll", "c:\\windows\\system32\\rundll32.exe",)),
    ("\\Microsoft\\Windows\\Servicing\\StartComponentCleanup", ("c:\\windows\\system32\\dism.exe",)),
    ("\\Microsoft\\Windows\\SystemRestore\\SR", ("c:\\windows\\system32\\srtasks.exe",)),
    ("\\Microsoft\\Windows\\Autochk\\Proxy", ("c:\\windows\\system32\\autochk",)),
    ("\\Microsoft\\Windows\\DiskDiagnostic\\Microsoft-Windows-DiskDiagnosticDataCollector", ("c:\\windows\\system32\\dfdwiz.exe",)),
    ("\\Microsoft\\Windows\\MUI\\LPRemove", ("c:\\windows\\system32\\lpremove.exe",)),
    ("\\Microsoft\\Windows\\NetTrace\\GatherNetworkInfo", ("c:\\windows\\system32\\netsh.exe",)),
    ("\\Microsoft\\Windows\\Power Efficiency Diagnostics\\AnalyzeSystem", ("c:\\windows\\system32\\powercfg.exe",)),
    ("\\Microsoft\\Windows\\Bluetooth\\UninstallDeviceTask", ("c:\\windows\\system32\\",)),
    ("\\Microsoft\\Windows\\Shell\\FamilySafetyMonitor", ("c:\\program files\\microsoft family safety\\",)),
    ("\\Microsoft\\Windows\\Shell\\FamilySafetyRefresh", ("c:\\program files\\microsoft family safety\\",)),
    ("\\Microsoft\\Windows\\WOF\\WIM-Hash-Management", ("c:\\windows\\system32\\wimserv.exe",)),
    ("\\Microsoft\\Windows\\WDI\\ResolutionHost", ("c:\\windows\\system32\\resolutionhost.exe", "c:\\windows\\system32\\dllhost.exe",)),
    ("\\Microsoft\\Windows\\Device Setup\\Metadata Refresh", ("c:\\windows\\system32\\devicecensus.exe", "c:\\windows\\system32\\",)),
)

# Techniques by number, with name and tactic.
TECHNIQUES = {
    "T1003": ("OS Credential Dumping", "Credential Access"),
    "T1003.001": ("LSASS Memory", "Credential Access"),
    "T1003.002": ("Security Account Manager", "Credential Access"),
    "T1003.004": ("LSA Secrets", "Credential Access"),
    "T1003.005": ("Cached Domain Credentials", "Credential Access"),
    "T1003.006": ("DCSync", "Credential Access"),
    "T1021": ("Remote Services", "Lateral Movement"),
    "T1021.002": ("SMB/Windows Admin Shares", "Lateral Movement"),
    "T1021.006": ("Windows Remote Management", "Lateral Movement"),
    "T1027": ("Obfuscated Files or Information", "Defense Evasion"),
    "T1033": ("System Owner/User Discovery", "Discovery"),
    "T1037.001": ("Boot or Logon Initialization Scripts: Logon Script (Windows)", "Persistence"),
    "T1047": ("Windows Management Instrumentation", "Execution"),
    "T1055": ("Process Injection", "Defense Evasion"),
    "T1055.003": ("Thread Execution Hijacking", "Defense Evasion"),
    "T1059.001": ("Command and Scripting Interpreter: PowerShell", "Execution"),
    "T1070": ("Indicator Removal", "Defense Evasion"),
    "T1090.003": ("Proxy: Multi-hop Proxy", "Command and Control"),
    "T1105": ("Ingress Tool Transfer", "Command and Control"),
    "T1106": ("Native API", "Execution"),
    "T1127": ("Trusted Developer Utilities Proxy Execution", "Defense Evasion"),
    "T1218.010": ("System Binary Proxy Execution: Regsvr32", "Defense Evasion"),
    "T1218.011": ("System Binary Proxy Execution: Rundll32", "Defense Evasion"),
    "T1543.003": ("Create or Modify System Process: Windows Service", "Persistence"),
    "T1546.003": ("Event Triggered Execution: WMI Event Subscription", "Persistence"),
    "T1547.001": ("Boot or Logon Autostart Execution: Registry Run Keys / Startup Folder", "Persistence"),
    "T1548": ("Abuse Elevation Control Mechanism", "Privilege Escalation"),
    "T1548.002": ("Bypass User Account Control", "Privilege Escalation"),
    "T1550.003": ("Use Alternate Authentication Material: Pass the Ticket", "Lateral Movement"),
    "T1558": ("Steal or Forge Kerberos Tickets", "Credential Access"),
    "T1559.001": ("Inter-Process Communication: Component Object Model", "Execution"),
    "T1564.003": ("Hide Artifacts: Hidden Window", "Defense Evasion"),
    "T1569.002": ("System Services: Service Execution", "Execution"),
    "T1570": ("Lateral Tool Transfer", "Lateral Movement"),
    "T1571": ("Non-Standard Port", "Command and Control"),
    "T1587.001": ("Develop Capabilities: Malware", "Resource Development"),
    "T1590": ("Gather Victim Network Information", "Reconnaissance"),
    "T1620": ("Reflective Code Loading", "Defense Evasion"),
}
