"""The shape of a snapshot document and of what is derived from it."""

from __future__ import annotations

#: JSON names of a snapshot document; every later section may be missing. Fixed values.
SNAPSHOT = """
schema_version STRING, version STRING, snapshot_id STRING, timestamp STRING, prev_hash STRING,
host STRUCT<hostname STRING, os STRING, kernel STRING, arch STRING, boot_id STRING, machine_id STRING>,
network STRUCT<
  interfaces ARRAY<STRUCT<name STRING, state STRING, mtu BIGINT, mac STRING, addresses ARRAY<STRING>,
    stats STRUCT<rx_bytes DECIMAL(20,0), tx_bytes DECIMAL(20,0), rx_packets DECIMAL(20,0), tx_packets DECIMAL(20,0),
      rx_errors DECIMAL(20,0), tx_errors DECIMAL(20,0), rx_dropped DECIMAL(20,0), tx_dropped DECIMAL(20,0)>>>,
  routes ARRAY<STRUCT<destination STRING, gateway STRING, device STRING, metric BIGINT, protocol STRING>>,
  dns STRUCT<nameservers ARRAY<STRING>, search_domains ARRAY<STRING>>>,
kernel_params MAP<STRING, STRING>, packages MAP<STRING, STRING>, services MAP<STRING, STRING>,
listening_ports ARRAY<STRUCT<port BIGINT, protocol STRING, address STRING, process STRING>>,
multicast_groups ARRAY<STRUCT<interface STRING, `group` STRING>>,
connections ARRAY<STRUCT<protocol STRING, local_addr STRING, local_port BIGINT, remote_addr STRING, remote_port BIGINT,
  state STRING, process STRING>>,
users ARRAY<STRUCT<name STRING, uid BIGINT, gid BIGINT, gecos STRING, home STRING, shell STRING>>,
groups ARRAY<STRUCT<name STRING, gid BIGINT, members ARRAY<STRING>>>,
sudoers ARRAY<STRUCT<source STRING, line STRING>>,
mounts ARRAY<STRUCT<source STRING, mount_point STRING, fs_type STRING, mount_options STRING, super_options STRING>>,
modules ARRAY<STRUCT<name STRING, size DECIMAL(20,0), dependencies ARRAY<STRING>>>,
cron_jobs ARRAY<STRUCT<source STRING, user STRING, schedule STRING, command STRING>>,
systemd_timers ARRAY<STRUCT<unit_file STRING, description STRING, on_calendar STRING, on_boot_sec STRING,
  on_unit_active_sec STRING, on_unit_inactive_sec STRING, unit STRING, randomized_delay_sec STRING>>,
ssh_keys ARRAY<STRUCT<user STRING, source STRING, type STRING, fingerprint STRING, comment STRING, options STRING>>,
cpu STRUCT<user DECIMAL(20,0), nice DECIMAL(20,0), system DECIMAL(20,0), idle DECIMAL(20,0), iowait DECIMAL(20,0),
  irq DECIMAL(20,0), softirq DECIMAL(20,0), steal DECIMAL(20,0), guest DECIMAL(20,0), guest_nice DECIMAL(20,0)>,
kernel_counters STRUCT<ip MAP<STRING, DECIMAL(20,0)>, tcp MAP<STRING, DECIMAL(20,0)>, udp MAP<STRING, DECIMAL(20,0)>>,
processes STRUCT<total_count BIGINT, top_by_rss ARRAY<STRUCT<pid BIGINT, ppid BIGINT, comm STRING, state STRING,
  rss_kb DECIMAL(20,0), vms_kb DECIMAL(20,0)>>>,
sockets STRUCT<total_tcp BIGINT, total_udp BIGINT, total_listen BIGINT,
  top_by_count ARRAY<STRUCT<pid BIGINT, comm STRING, tcp_count BIGINT, udp_count BIGINT>>>,
nic_drivers MAP<STRING, STRUCT<driver STRING, version STRING, fw_version STRING>>,
collector_errors ARRAY<STRING>
"""

ENTITY = "host_id STRING, seq BIGINT, section STRING, ekey STRING, dkey STRING, label STRING, singleton BOOLEAN, fields MAP<STRING, STRING>, counters MAP<STRING, DECIMAL(20,0)>"
RULE = "id STRING, name STRING, description STRING, severity STRING, section STRING, change_type STRING, key_pattern STRING, pro BOOLEAN"
GENESIS = "0" * 64
