"""Code lines that show what the built-in rules find: for corpora and tests."""

#: By language and rule, a line that the rule finds.
FINDS = {
    "C": {
        "gets": "while (gets (line)) n++;",
        "strcpy": "strcpy(a->name, argv[1]);",
        "strcat": "strcat (out, in);",
        "sprintf": 'sprintf(msg, "%d", n);',
        "scanf-no-width": 'scanf("%d %s", &n, word);',
        "memcpy-no-bounds": "memcpy(to, from, n);",
        "malloc-no-null-check": "p = malloc (n);",
        "alloca-stack-overflow": "char *t = alloca(len + 1);",
        "printf-format-string": "printf( msg );",
        "vprintf-format-string": "vfprintf(log, fmt, ap);",
        "system-call": "return system(line);",
        "popen": 'f = popen(cmd, "r");',
        "exec-family": "execle(path, arg, NULL, env);",
        "dlopen-user-path": "lib = dlopen(name, 0);",
        "tmpnam-toctou": 'n = tempnam("/tmp", "x");',
        "chroot-no-chdir": "if (chroot(dir) < 0) die();",
        "getenv-unchecked": 'home = getenv("HOME");',
        "mmap-exec": "m = mmap(NULL, n, PROT_WRITE | PROT_EXEC, flags, -1, 0);",
        "rand-for-security": "token = rand( );",
        "atoi-no-validation": "n = atoi(argv[2]);",
    },
    "C++": {
        "gets": "gets(line);",
        "strcpy": "strcpy(name, s.c_str());",
        "sprintf": 'sprintf(t, "%s", s);',
        "system-call": "std::system(line.c_str());",
        "printf-format-string": "printf(text, 1);",
        "rand-for-security": "int r = std::rand();",
        "raw-new-array": "auto a = new std::pair<int>[n];",
        "integer-overflow-alloc": "auto a = new int[rows * columns];",
        "delete-without-bracket": "delete  node;",
        "reinterpret-cast": "auto b = reinterpret_cast <byte*>(p);",
        "const-cast": "const_cast<T&>(t).f();",
        "c-style-cast": "n = (int) x;",
        "dynamic-cast-unchecked": "auto d = dynamic_cast<Leaf*>(n);",
        "throw-in-destructor": "~File() noexcept(false) { if (bad) throw Error(); }",
        "catch-all-swallow": "catch ( ... ) { }",
        "raw-pointer-arithmetic": "x = *(p + 3);",
        "memset-object": "memset(&state, 0, sizeof state);",
        "use-after-move": "take(std::move(v));",
    },
    "C#/.NET": {
        "sql-injection-concat": 'var c = new SqlCommand("select " + name, db);',
        "sql-string-format": 'q = String.Format("delete from {0}", t);',
        "process-start-input": 'Process.Start("tool " + arg);',
        "binary-formatter": "new binaryformatter().Deserialize(s);",
        "losformatter": "var f = new ObjectStateFormatter();",
        "soap-formatter": "new NetDataContractSerializer();",
        "type-name-handling": "s.TypeNameHandling = TypeNameHandling . Objects;",
        "ldap-injection": 'new DirectoryEntry("LDAP://" + host);',
        "xpath-injection": 'd.SelectSingleNode("//a[" + i + "]");',
        "xss-response-write": 'Response.Write("hi " + Request["n"]);',
        "path-traversal": 'File.Delete(Request.Form["f"]);',
        "open-redirect": "return LocalRedirect(url);",
        "hardcoded-password": 'ApiKey = "abcd1234";',
        "hardcoded-connstring": 'ConnectionString = "Data Source=db";',
        "md5-sha1": "var h = SHA1.Create();",
        "weak-cipher": "new RC2CryptoServiceProvider();",
        "ecb-mode": "m = ciphermode.ecb;",
        "cert-validation-bypass": "h.ServerCertificateValidationCallback = Ok;",
        "ssrf-webclient": "new WebClient().DownloadString(uri);",
        "weak-prng": "var r = new Random();",
        "unsafe-block": "unsafe {",
        "xmldocument-dtd": "var d = new XmlDocument();",
        "reflection-invoke": "Assembly.Load(name);",
        "cookie-missing-flags": 'new HttpCookie("id");',
        "regex-redos": 'new Regex("^" + input);',
    },
    "Rust": {
        "unsafe-block": "let n = unsafe { f() };",
        "send-sync-impl": "unsafe impl Sync for Cell2 {}",
        "transmute": "mem::transmute::<A, B>(a)",
        "from-utf8-unchecked": "str::from_utf8_unchecked (b)",
        "from-raw-parts": "slice::from_raw_parts(p, n)",
        "from-raw-parts-mut": "slice::from_raw_parts_mut(p, n)",
        "box-from-raw": "drop(Box::from_raw(p));",
        "nonnull-new-unchecked": "NonNull::new_unchecked(p)",
        "cstr-from-ptr": "CStr::from_ptr(p).to_str()",
        "raw-pointer-deref": "let x = * mut node_ptr;",
        "ptr-read-write": "ptr::copy_nonoverlapping(a, b, n);",
        "maybe-uninit-assume-init": "x.assume_init ()",
        "vec-set-len": "buf.set_len(n);",
        "forget": "std::mem::forget(guard);",
        "ffi-extern": 'extern "C" {',
        "hardcoded-secret": 'const db_token: &str = "x";',
        "unwrap-in-code": "f().unwrap()?;",
        "expect-in-code": 'f().expect( "no f")',
        "integer-arithmetic": "let i = n as i128;",
        "env-vars-in-proc": "for a in std::env::args() {",
    },
}
