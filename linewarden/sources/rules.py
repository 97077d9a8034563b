"""The built-in rule catalogue: 83 line rules for four languages.

Each rule is ``(name, severity, cwe, regex, needles, description)`` and its position in the list is
its ordinal (the tie-break when several rules hit one line).

``needles`` is a performance hint only: lower-case literals of which at least one occurs in every
line the regex can match.  The scan checks them with a plain byte search before it runs the regex.
An empty tuple means "no hint".
"""

C = "C"
CPP = "C++"
DOTNET = "C#/.NET"
RUST = "Rust"

# --- fixed values: language labels, in catalogue order ---------------------------------------
LANGUAGES = (C, CPP, DOTNET, RUST)

# --- fixed values: file extension -> language (case-sensitive) --------------------------------
EXTENSIONS = {
    "c": C,
    "h": C,
    "cpp": CPP,
    "cc": CPP,
    "cxx": CPP,
    "hpp": CPP,
    "hxx": CPP,
    "cs": DOTNET,
    "rs": RUST,
}

# --- fixed values: names accepted for a language override -------------------------------------
OVERRIDES = {"c": C, "cpp": CPP, "cs": DOTNET, "rust": RUST}

# --- fixed values: rule names, severities, CWE numbers and patterns, in catalogue order --------
RULES = {
    C: [
        ("gets", "CRITICAL", 120, r"\bgets\s*\(", ("gets",),
         "gets() reads without any limit, so long input always overruns the buffer; read with fgets()."),
        ("strcpy", "HIGH", 120, r"\bstrcpy\s*\(", ("strcpy",),
         "strcpy() ignores the size of its target; use a bounded copy such as strlcpy()."),
        ("strcat", "HIGH", 120, r"\bstrcat\s*\(", ("strcat",),
         "strcat() ignores the room left in its target; use a bounded append."),
        ("sprintf", "HIGH", 120, r"\bsprintf\s*\(", ("sprintf",),
         "sprintf() ignores the size of its target; use snprintf()."),
        ("scanf-no-width", "HIGH", 120, r'\bscanf\s*\(\s*"[^"]*%s[^"]*"', ("scanf",),
         "A bare %s in scanf() stores input of any length; give a field width."),
        ("memcpy-no-bounds", "MEDIUM", 120, r"\bmemcpy\s*\(", ("memcpy",),
         "memcpy() trusts its length argument; check it against the target size."),
        ("malloc-no-null-check", "MEDIUM", 476, r"\bmalloc\s*\(", ("malloc",),
         "malloc() may return NULL; test the pointer before using it."),
        ("alloca-stack-overflow", "HIGH", 121, r"\balloca\s*\(", ("alloca",),
         "alloca() with a large size exhausts the stack; allocate on the heap or bound the size."),
        ("printf-format-string", "HIGH", 134, r"\bprintf\s*\(\s*[a-zA-Z_][a-zA-Z0-9_]*\s*[,)]", ("printf",),
         "A variable is used as printf() format; pass a literal format string."),
        ("vprintf-format-string", "HIGH", 134, r"\bv(?:printf|fprintf|sprintf|snprintf|dprintf)\s*\(", ("printf",),
         "A v*printf() call with a foreign format can read and write memory; keep the format literal."),
        ("system-call", "CRITICAL", 78, r"\bsystem\s*\(", ("system",),
         "system() runs its text in a shell; start programs with an argument vector."),
        ("popen", "HIGH", 78, r"\bpopen\s*\(", ("popen",),
         "popen() runs its text in a shell; clean the input or avoid the shell."),
        ("exec-family", "CRITICAL", 78, r"\b(?:execl|execlp|execvp|execle|execve)\s*\(", ("exec",),
         "An exec call with outside input can start any program; fix the path and check the arguments."),
        ("dlopen-user-path", "HIGH", 426, r"\bdlopen\s*\(", ("dlopen",),
         "dlopen() of a path that others control loads their code; use fixed library paths."),
        ("tmpnam-toctou", "HIGH", 377, r"\b(?:tmpnam|tempnam)\s*\(", ("tmpnam", "tempnam"),
         "The name can be taken between tmpnam() and open(); use mkstemp()."),
        ("chroot-no-chdir", "HIGH", 243, r"\bchroot\s*\(", ("chroot",),
         "After chroot() alone the old working directory still leads outside (CWE-243); chdir to the new root."),
        ("getenv-unchecked", "MEDIUM", 807, r"\bgetenv\s*\(", ("getenv",),
         "Environment values come from outside; check them before use."),
        ("mmap-exec", "HIGH", 114, r"\bmmap\s*\([^)]*PROT_EXEC", ("mmap",),
         "This mapping is executable; together with write access it can run injected code."),
        ("rand-for-security", "MEDIUM", 338, r"\brand\s*\(\s*\)", ("rand",),
         "rand() is predictable; use the random source of the operating system."),
        ("atoi-no-validation", "LOW", 190, r"\batoi\s*\(", ("atoi",),
         "atoi() cannot report bad input or overflow; use strtol()."),
    ],
    CPP: [
        ("gets", "CRITICAL", 120, r"\bgets\s*\(", ("gets",),
         "gets() reads without any limit, so long input always overruns the buffer; use std::getline()."),
        ("strcpy", "HIGH", 120, r"\bstrcpy\s*\(", ("strcpy",),
         "strcpy() ignores the size of its target; use std::string or a bounded copy."),
        ("sprintf", "HIGH", 120, r"\bsprintf\s*\(", ("sprintf",),
         "sprintf() ignores the size of its target; use snprintf() or a string stream."),
        ("system-call", "CRITICAL", 78, r"\bsystem\s*\(", ("system",),
         "system() runs its text in a shell; start programs with an argument vector."),
        ("printf-format-string", "HIGH", 134, r"\bprintf\s*\(\s*[a-zA-Z_][a-zA-Z0-9_]*\s*[,)]", ("printf",),
         "A variable is used as printf() format; pass a literal format string or use streams."),
        ("rand-for-security", "MEDIUM", 338, r"\bstd::rand\s*\(\s*\)|\brand\s*\(\s*\)", ("rand",),
         "rand() is predictable; use std::random_device or the random source of the operating system."),
        ("raw-new-array", "HIGH", 401, r"\bnew\s+\w[\w:<>]*\s*\[", ("new",),
         "An array from new[] must be freed by hand; let a container own it."),
        ("integer-overflow-alloc", "HIGH", 190, r"\bnew\s+\w[\w:<>]*\s*\[\s*\w+\s*\*", ("new",),
         "The product in this array size can wrap and give a short allocation; check it first."),
        ("delete-without-bracket", "HIGH", 762, r"\bdelete\s+[^\[\s]", ("delete",),
         "Plain delete on memory from new[] is undefined; use delete[] there."),
        ("reinterpret-cast", "HIGH", 704, r"\breinterpret_cast\s*<", ("reinterpret_cast",),
         "reinterpret_cast goes around the type system and may break aliasing rules."),
        ("const-cast", "MEDIUM", 704, r"\bconst_cast\s*<", ("const_cast",),
         "const_cast drops a promise; writing to an object that was const is undefined."),
        ("c-style-cast", "LOW", 704, r"\(char\s*\*\)\s*\w|\(void\s*\*\)\s*\w|\(int\s*\)\s*\w", ("(char", "(void", "(int"),
         "A C cast skips the checks of the C++ casts; use the named casts."),
        ("dynamic-cast-unchecked", "MEDIUM", 476, r"\bdynamic_cast\s*<[^>]+\*>", ("dynamic_cast",),
         "A pointer dynamic_cast gives nullptr on mismatch; test the result."),
        ("throw-in-destructor", "HIGH", 703, r"~\w+\s*\([^)]*\)[^{]*\{[^}]*throw\b", ("~",),
         "An exception that leaves a destructor during unwinding ends the program."),
        ("catch-all-swallow", "MEDIUM", 390, r"catch\s*\(\s*\.\.\.\s*\)\s*\{\s*\}", ("catch",),
         "This handler hides every exception; log it or throw it again."),
        ("raw-pointer-arithmetic", "MEDIUM", 467, r"\*\s*\(\s*\w+\s*\+", ("*",),
         "Arithmetic on a raw pointer is easy to get wrong; use spans, iterators or indexes."),
        ("memset-object", "MEDIUM", 119, r"\bmemset\s*\(\s*(?:this|&\w+)\s*,", ("memset",),
         "memset on an object with non-trivial members is undefined; use constructors."),
        ("use-after-move", "LOW", 416, r"\bstd::move\s*\(\s*\w+\s*\)", ("std::move",),
         "After a move the value is unspecified; assign before the next use."),
    ],
    DOTNET: [
        ("sql-injection-concat", "CRITICAL", 89,
         r"(?i)(SqlCommand|ExecuteQuery|ExecuteReader|ExecuteNonQuery|ExecuteScalar)\s*\([^)]*\+",
         ("sqlcommand", "executequery", "executereader", "executenonquery", "executescalar"),
         "SQL text is joined from parts and can be injected; bind parameters."),
        ("sql-string-format", "CRITICAL", 89,
         r'(?i)string\.Format\s*\(\s*"[^"]*SELECT|string\.Format\s*\(\s*"[^"]*INSERT|string\.Format\s*\(\s*"[^"]*UPDATE|string\.Format\s*\(\s*"[^"]*DELETE',
         ("string.format",),
         "SQL text is made with string.Format and can be injected; bind parameters."),
        ("process-start-input", "CRITICAL", 78, r"(?i)Process\.Start\s*\([^)]*\+", ("process.start",),
         "A joined command reaches Process.Start; allow only known values."),
        ("binary-formatter", "CRITICAL", 502, r"(?i)\bBinaryFormatter\b", ("binaryformatter",),
         "BinaryFormatter can run code from the data it reads; use a safe serializer."),
        ("losformatter", "CRITICAL", 502, r"(?i)\bLosFormatter\b|\bObjectStateFormatter\b",
         ("losformatter", "objectstateformatter"),
         "This formatter can run code from the data it reads; replace it."),
        ("soap-formatter", "CRITICAL", 502, r"(?i)\b(?:SoapFormatter|NetDataContractSerializer)\b",
         ("soapformatter", "netdatacontractserializer"),
         "This serializer can run code from the data it reads; allow only known types."),
        ("type-name-handling", "CRITICAL", 502, r"(?i)TypeNameHandling\s*\.\s*(?:All|Objects|Auto|Arrays)",
         ("typenamehandling",),
         "Type names taken from JSON let the sender choose classes (CWE-502); switch the feature off."),
        ("ldap-injection", "CRITICAL", 90, r"(?i)(?:DirectorySearcher|DirectoryEntry)\s*\([^)]*\+",
         ("directorysearcher", "directoryentry"),
         "The LDAP filter is joined from parts and can be injected (CWE-90); encode the input."),
        ("xpath-injection", "CRITICAL", 643,
         r"(?i)\.(?:SelectNodes|SelectSingleNode|XPathSelectElement|XPathSelectElements)\s*\([^)]*\+",
         (".selectnodes", ".selectsinglenode", ".xpathselectelement"),
         "The XPath text is joined from parts and can be injected (CWE-643); check the input."),
        ("xss-response-write", "HIGH", 79,
         r"(?i)Response\.Write\s*\([^)]*(?:Request\b|\bInput\b|\bParam\b|\bQuery\b)", ("response.write",),
         "Request data is written to the page without encoding (CWE-79)."),
        ("path-traversal", "HIGH", 22,
         r"(?i)File\.(Open|ReadAll|WriteAll|ReadText|WriteText|Create|Delete)\s*\([^)]*Request\.", ("file.",),
         "A file path comes from the request; resolve it and keep it under a fixed root."),
        ("open-redirect", "HIGH", 601,
         r"(?i)(?:Response\.Redirect|Redirect|LocalRedirect)\s*\([^)]*(?:Request\b|\burl\b|\bUri\b|\bredirect\b)",
         ("redirect",),
         "The redirect target comes from outside (CWE-601); allow only local or known targets."),
        ("hardcoded-password", "HIGH", 798,
         r'(?i)(password|passwd|pwd|secret|apikey|api_key)\s*=\s*"[^"]{4,}"',
         ("password", "passwd", "pwd", "secret", "apikey", "api_key"),
         "A credential is written in the source; load it from a secret store."),
        ("hardcoded-connstring", "HIGH", 798, r'(?i)connectionString\s*=\s*"[^"]{8,}"', ("connectionstring",),
         "A connection string is written in the source; load it from a secret store."),
        ("md5-sha1", "HIGH", 327,
         r"(?i)\bMD5\.Create\b|\bSHA1\.Create\b|\bMD5CryptoServiceProvider\b|\bSHA1CryptoServiceProvider\b",
         ("md5", "sha1"),
         "MD5 and SHA-1 are broken; use SHA-256 or a password hash."),
        ("weak-cipher", "HIGH", 327,
         r"(?i)\b(?:DESCryptoServiceProvider|TripleDESCryptoServiceProvider|RC2CryptoServiceProvider)\b",
         ("cryptoserviceprovider",),
         "DES, 3DES and RC2 are broken (CWE-327); use AES-GCM."),
        ("ecb-mode", "HIGH", 327, r"(?i)CipherMode\.ECB", ("ciphermode.ecb",),
         "ECB shows repeated blocks (CWE-327); use an authenticated mode."),
        ("cert-validation-bypass", "HIGH", 295, r"(?i)ServerCertificateValidationCallback\s*=",
         ("servercertificatevalidationcallback",),
         "A custom certificate callback may accept anything (CWE-295)."),
        ("ssrf-webclient", "HIGH", 918,
         r"(?i)(?:new\s+WebClient|HttpClient)[^;]*\.\s*(?:DownloadString|GetStringAsync|GetAsync|DownloadData)\s*\([^)]*(?:url|Uri|redirect|Request\.)",
         ("webclient", "httpclient"),
         "The server fetches an address from outside (CWE-918); allow only known hosts."),
        ("weak-prng", "MEDIUM", 338, r"\bnew\s+Random\s*\(", ("random",),
         "System.Random is predictable; use RandomNumberGenerator."),
        ("unsafe-block", "MEDIUM", None, r"\bunsafe\s*\{", ("unsafe",),
         "An unsafe block leaves the memory safety of the runtime; review its pointers."),
        ("xmldocument-dtd", "MEDIUM", 611, r"(?i)\bXmlDocument\b|\bXmlTextReader\b", ("xmldocument", "xmltextreader"),
         "This XML reader may resolve external entities; forbid DTDs."),
        ("reflection-invoke", "MEDIUM", 470, r"(?i)\.Invoke\s*\([^)]*\)|Assembly\.Load\s*\(",
         (".invoke", "assembly.load"),
         "Reflection on names from outside can run other code; check the names."),
        ("cookie-missing-flags", "MEDIUM", 1004, r"(?i)new\s+HttpCookie\s*\(", ("httpcookie",),
         "Set HttpOnly and Secure on cookies that hold sessions (CWE-1004, CWE-614)."),
        ("regex-redos", "LOW", 1333, r"(?i)new\s+Regex\s*\([^)]*\+[^)]*\)", ("regex",),
         "A regex joined from input may run for very long; use fixed patterns and limits."),
    ],
    RUST: [
        ("unsafe-block", "MEDIUM", None, r"\bunsafe\s*\{", ("unsafe",),
         "An unsafe block leaves the checks of the compiler; review validity, aliasing and lifetimes."),
        ("send-sync-impl", "HIGH", 362, r"unsafe\s+impl\s+(?:Send|Sync)\s+for", ("unsafe",),
         "A manual Send or Sync claims thread safety; prove it."),
        ("transmute", "HIGH", 843, r"\bstd::mem::transmute\b|\bmem::transmute\b", ("mem::transmute",),
         "transmute reads bytes as another type; use safe conversions."),
        ("from-utf8-unchecked", "HIGH", None,
         r"\bString::from_utf8_unchecked\s*\(|\bstr::from_utf8_unchecked\s*\(", ("::from_utf8_unchecked",),
         "Unchecked text that is not UTF-8 is undefined; use the checked form."),
        ("from-raw-parts", "HIGH", None, r"\bslice::from_raw_parts\s*\(", ("slice::from_raw_parts",),
         "A slice from raw parts needs a valid pointer and length; write down why they are."),
        ("from-raw-parts-mut", "HIGH", None, r"\bslice::from_raw_parts_mut\s*\(", ("slice::from_raw_parts_mut",),
         "A mutable slice from raw parts must be the only access to that memory."),
        ("box-from-raw", "HIGH", 416, r"\bBox::from_raw\s*\(", ("box::from_raw",),
         "Box::from_raw takes ownership; a second owner means a double free."),
        ("nonnull-new-unchecked", "HIGH", 476, r"\bNonNull::new_unchecked\s*\(", ("nonnull::new_unchecked",),
         "A null pointer here is undefined; use NonNull::new()."),
        ("cstr-from-ptr", "HIGH", None, r"\bCStr::from_ptr\s*\(", ("cstr::from_ptr",),
         "CStr::from_ptr needs a live, nul-terminated pointer; check where it comes from."),
        ("raw-pointer-deref", "HIGH", 476, r"\*\s*(mut\s+)?\w+_ptr\b|\*\s*raw\b", ("*",),
         "A raw pointer is read; make sure that it is valid and aligned."),
        ("ptr-read-write", "HIGH", None,
         r"\bptr::(?:read|write|read_unaligned|write_unaligned|copy|copy_nonoverlapping)\s*\(", ("ptr::",),
         "Raw reads and writes skip ownership rules; check validity and aliasing."),
        ("maybe-uninit-assume-init", "HIGH", 908, r"\.assume_init\s*\(", (".assume_init",),
         "assume_init() on memory that is not fully set is undefined."),
        ("vec-set-len", "HIGH", 908, r"\.set_len\s*\(", (".set_len",),
         "set_len() may expose unset elements; prefer resize() or extend()."),
        ("forget", "MEDIUM", None, r"\bstd::mem::forget\b|\bmem::forget\b", ("mem::forget",),
         "mem::forget skips Drop and leaks; prefer ManuallyDrop."),
        ("ffi-extern", "MEDIUM", None, r'\bextern\s+"C"\s*\{', ("extern",),
         "Foreign signatures and lifetimes are not checked; compare them with the C side."),
        ("hardcoded-secret", "HIGH", 798,
         r'(?i)\bconst\s+\w*(?:PASSWORD|SECRET|KEY|TOKEN|APIKEY|API_KEY)\w*\s*(?::\s*\S+\s*)?=\s*"',
         ("password", "secret", "key", "token"),
         "A secret is written in the source; load it from a secret store."),
        ("unwrap-in-code", "LOW", 390, r"\.unwrap\(\)", (".unwrap()",),
         "unwrap() panics on a missing value; pass the error on."),
        ("expect-in-code", "LOW", 390, r'\.expect\s*\(\s*"', (".expect",),
         "expect() panics with a message; pass the error on."),
        ("integer-arithmetic", "LOW", 197,
         r"(?:as\s+u(?:8|16|32|64|128|size)|as\s+i(?:8|16|32|64|128|size))", ("as",),
         "An as cast may cut the value silently; use try_into() or checked arithmetic."),
        ("env-vars-in-proc", "LOW", 807, r"std::env::var\s*\(|std::env::args\s*\(", ("std::env::",),
         "Arguments and environment come from outside; check them before use."),
    ],
}
