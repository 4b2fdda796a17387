from postura.operators import reports as R

HOST, PORT = "ord long, ip string, hostname string", "ord long, ip string, port int, protocol string, service string, risk string"


def lines(df):
    return [r.line for r in df.orderBy("section", "place").collect()]


def parts(spark, new=(), gone=(), opened=(), closed=(), risky=()):
    return {n: spark.createDataFrame(list(rows), HOST if n.endswith("hosts") else PORT) for n, rows in zip(R.NAMES, (new, gone, opened, closed, risky))}


def test_a_difference_with_everything(spark):
    risky = (3, "10.0.0.1", 23, "tcp", 'tel,"net"', "P0")
    p = parts(spark, [(2, "10.0.0.2", None), (1, "10.0.0.9", "nas, big")], [], [(1, "10.0.0.1", 80, "tcp", None, None), risky], [], [risky])
    assert lines(R.diff_csv(p, 'a "b"', "t1", "t2")) == [
        "# SUMMARY", "Metric,Value", 'Network,"a ""b"""', "Baseline Scan,t1", "Current Scan,t2", "New Hosts,2", "Removed Hosts,0", "Ports Opened,2", "Ports Closed,0", "Risky Exposures,1",
        "", "# NEW HOSTS", "IP Address,Hostname", '10.0.0.9,"nas, big"', "10.0.0.2,N/A", "", "# REMOVED HOSTS", "No hosts removed",
        "", "# PORTS OPENED", "IP Address,Port,Protocol,Service,Risk Level", "10.0.0.1,80,tcp,unknown,N/A", '10.0.0.1,23,tcp,"tel,""net""",P0', "", "# PORTS CLOSED", "No ports closed",
        "", "# RISKY EXPOSURES (P0/P1)", "IP Address,Port,Protocol,Service,Risk Level", '10.0.0.1,23,tcp,"tel,""net""",P0']
    text = "\n".join(lines(R.change_report(p, "home", "a", "b")))
    assert "- New hosts: **2**" in text and "## Removed hosts\n- (none)\n" in text and "| ip | port | protocol | service |\n|---|---|---|---|\n| 10.0.0.1 | 80 | tcp |  |" in text and "## Ports closed\n_(none)_\n" in text
    assert lines(R.watch_csv(p["risky"])) == ["IP Address,Port,Protocol,Service,Risk Level,Recommended Action", '10.0.0.1,23,tcp,"tel,""net""",P0,Review and remediate']


def test_no_difference_and_long_tables(spark):
    none = parts(spark)
    assert "No new ports opened" in lines(R.diff_csv(none, "n", "a", "b")) and "# RISKY EXPOSURES (P0/P1)" not in lines(R.diff_csv(none, "n", "a", "b"))
    assert lines(R.watch_csv(none["risky"])) == ["No risky exposures detected"]
    many = parts(spark, opened=[(i, f"10.0.{i // 256}.{i % 256}", 80, "tcp", "a|b", None) for i in range(500)])
    got = lines(R.change_report(many, "n", "a", "b"))
    assert sum(x.startswith("| 10.") for x in got) == 200 and "- Ports opened (new exposures): **500**" in got and "| 10.0.0.0 | 80 | tcp | a\\|b |" in got
